"""Texts that look the same brought to one form of characters.

A mapping from characters, and sequences of characters, to what they look like is computed once by rule from
the character database (widths, ligatures, spaces, hyphens, invisible characters) and from fixed lists of
look-alike letters and overlays, and checked for conflicts. It is compiled to one
longest-match transducer over grapheme clusters: a text is read once, clusters of plain ASCII
pass untouched, and every other cluster is rewritten as a whole and composed.

The form is a key for comparisons: it writes a letter of any script by the one letter that stands for its
look. The readable form keeps the letters of a word's own script, and only letters that stand in for
another script's inside a mixed word are written in it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

#: Letters of other scripts and the letters they look like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l", "Ӏ": "I", "Ѵ": "V",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "π": "п", "τ": "т", "Γ": "Г", "Π": "П", "Φ": "Ф",
    # Armenian
    "օ": "o", "Օ": "O", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "Ս": "U",
    # Latin letters of phonetic use and small capitals
    "ɡ": "g", "ɑ": "a", "\u00b5": "\u03bc", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V",
    "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p",
    "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲭ": "x",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: A letter with an overlay or a dot of its own, and the one letter it looks like.
SEQUENCES = {
    "o\u0338": "ø", "O\u0338": "Ø", "o\u0337": "ø", "O\u0337": "Ø", "l\u0338": "ł", "L\u0338": "Ł", "l\u0335": "ƚ", "d\u0335": "đ", "D\u0335": "Đ",
    "h\u0335": "ħ", "H\u0335": "Ħ", "t\u0335": "ŧ", "T\u0335": "Ŧ", "b\u0335": "ƀ", "i\u0335": "ɨ", "u\u0335": "ʉ", "z\u0335": "ƶ", "Z\u0335": "Ƶ",
    "g\u0335": "ǥ", "G\u0335": "Ǥ", "\u0131\u0307": "i", "\u0237\u0307": "j", "i\u0307": "i", "j\u0307": "j",
}
#: Hyphens that look like the plain one; minus signs and dashes look longer.
HYPHENS = "\u2010\u2011"
#: Ranges of characters that show nothing.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
)
JOINER = "\u200d"


def build_mapping(letters: bool = True) -> dict[str, str]:
    """Source, of one or more characters, to replacement, by rule; raises on a conflict. ``letters`` takes in the look-alike letters."""
    out: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if out.get(source, target) != target:
            raise ValueError(f"{source.encode('unicode_escape').decode()} has two replacements")
        out[source] = target

    for low, high in INVISIBLE:
        for cp in range(low, high + 1):
            put(chr(cp), "")
    for source in HYPHENS:
        put(source, "-")
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if c in out:
            continue
        if unicodedata.category(c) == "Zs" and cp != 0x1680:
            put(c, " ")
            continue
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        ligature = kind == "<compat>" and (0xFB00 <= cp <= 0xFB17 or cp in (0x132, 0x133, *range(0x1C7, 0x1CD)))
        if kind in ("<wide>", "<narrow>") or ligature:
            put(c, unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split())))
    for source, target in (LOOKALIKES if letters else {"\u00b5": "\u03bc"}).items():
        put(source, target)
    for source, target in SEQUENCES.items():
        put(unicodedata.normalize("NFD", source), target)
    # Replacements are themselves brought to their end, so that applying the mapping twice changes nothing.
    for source, target in out.items():
        seen = {source}
        while (further := "".join(out.get(c, c) for c in target)) != target:
            if further in seen:
                raise ValueError(f"{source.encode('unicode_escape').decode()} leads in a circle")
            seen.add(further)
            target = further
        out[source] = target
    return out


class Transducer:
    """The compiled mapping; one instance per worker process."""

    def __init__(self, mapping: dict[str, str] | None = None):
        self.mapping = build_mapping() if mapping is None else mapping
        self.single = {s: t for s, t in self.mapping.items() if len(s) == 1}
        self.longer: dict[str, list[tuple[str, str]]] = {}
        for source, target in sorted(self.mapping.items(), key=lambda x: -len(x[0])):
            if len(source) > 1:
                self.longer.setdefault(source[0], []).append((source, target))
        mark = (
            r"[\p{M}\u00AD\u034F\u061C\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFE00-\uFE0F\uFEFF\uFF9E\uFF9F"
            r"\U000E0000-\U000E0FFF]"
        )
        tone = r"[\p{Emoji_Modifier}\uFE0F]*"
        emoji = rf"\p{{Extended_Pictographic}}{tone}(?:\u200D\p{{Extended_Pictographic}}{tone})+"
        jamo = r"[\u1100-\u11FF\uFFA0-\uFFDC]+"
        self.pattern = regex.compile(rf"(?P<joined>{emoji})|{jamo}{mark}*|[\x00-\x7f]{mark}+|[^\x00-\x7f]{mark}*")
        self.known: dict[str, str] = {}

    def longest(self, text: str) -> str:
        """The text with the longest source at every place replaced."""
        if not any(c in self.longer for c in text):
            return "".join([self.single.get(c, c) for c in text])
        out, i = [], 0
        while i < len(text):
            for source, target in self.longer.get(text[i], ()):
                if text.startswith(source, i):
                    out.append(target)
                    i += len(source)
                    break
            else:
                out.append(self.single.get(text[i], text[i]))
                i += 1
        return "".join(out)

    def cluster(self, text: str) -> str:
        """The form of one grapheme cluster."""
        # Single characters first, so that a sequence is met whatever its letter was written as.
        bare = "".join([self.single.get(c, c) for c in text])
        return unicodedata.normalize("NFC", self.longest(unicodedata.normalize("NFD", bare)))

    def _rewrite(self, match) -> str:
        text = match[0]
        form = self.known.get(text)
        if form is None:
            if match["joined"]:
                form = "".join(c for c in text if c == JOINER or self.mapping.get(c, c))
            else:
                form = self.cluster(text)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text] = form
        return form

    def apply(self, text: str) -> str:
        """The one form of a text; a plain ASCII text is its own."""
        if text.isascii():
            return text
        # A mark can meet its base only after an invisible base between them is gone.
        return unicodedata.normalize("NFC", self.pattern.sub(self._rewrite, text))


class Reader:
    """The readable form: one writing of widths, accents, ligatures, spaces and hyphens, and words in one script."""

    SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")

    def __init__(self):
        self.plain = Transducer(build_mapping(letters=False))
        self.word = regex.compile(r"(?=[\p{L}\p{M}]*[^\x00-\x7f])\p{L}[\p{L}\p{M}]+")
        self.script = {s: regex.compile(rf"\p{{Script={s}}}") for s in self.SCRIPTS}
        self.to_latin = {s: t for s, t in LOOKALIKES.items() if t.isascii()}
        self.from_latin: dict[str, dict[str, str]] = {}
        for source, target in self.to_latin.items():
            self.from_latin.setdefault(self._script(source) or "", {}).setdefault(target, source)

    def _script(self, letter: str) -> str | None:
        return next((s for s, p in self.script.items() if p.match(letter)), None)

    def _one_script(self, match) -> str:
        word = match[0]
        scripts = {x for c in word if c.isalpha() and (x := self._script(c))}
        if len(scripts) < 2:
            return word
        # Letters that look like no Latin one tell whose word it is; where there are none it is a Latin word.
        telling = {self._script(c) for c in word if c.isalpha() and c not in self.to_latin} - {None}
        if telling <= {"Latin"}:
            return "".join(self.to_latin.get(c, c) for c in word)
        foreign = telling - {"Latin"}
        if len(foreign) == 1:
            back = self.from_latin.get(next(iter(foreign)), {})
            if all(c in back for c in word if self._script(c) == "Latin"):
                return "".join(back.get(c, c) for c in word)
        return word

    def apply(self, text: str) -> str:
        """The readable form of a text."""
        if text.isascii():
            return text
        plain = self.plain.apply(text)
        letters = [c for c in set(plain) if not c.isascii() and c.isalpha()]
        # Where a text has no letter that could only be of a script, its look-alikes all stand for Latin letters.
        told = {self._script(c) for c in letters if c not in self.to_latin}
        swap = {ord(c): t for c in letters if (t := self.to_latin.get(c)) and self._script(c) not in told}
        return unicodedata.normalize("NFC", self.word.sub(self._one_script, plain.translate(swap) if swap else plain))


_ready: dict[type, Transducer | Reader] = {}


def ready(kind: type) -> Transducer | Reader:
    """The process-wide transducer or reader."""
    if kind not in _ready:
        _ready[kind] = kind()
    return _ready[kind]


def consistent_text(docs: DataFrame, key: str = "doc_id", text: str = "text", readable: bool = True) -> DataFrame:
    """``key, text, consistent, readable``: each text, its one form for comparisons, and a form to read.

    Null stays null, empty stays empty. Without ``readable`` that column is left out.
    """
    names = [key, "text", "consistent", *(["readable"] if readable else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = [ready(Transducer).apply, *([ready(Reader).apply] if readable else [])]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [pa.array([None if x is None else apply(x) for x in texts], pa.string()) for apply in applied]
            yield pa.RecordBatch.from_arrays([*batch.columns, *forms], names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` bigint, " + ", ".join(f"{n} string" for n in names[1:]))


def _digest(col: str) -> list:
    return [F.xxhash64(col).alias(f"{col}_1"), F.xxhash64(F.lit("second"), col).alias(f"{col}_2")]


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, text_id`` of every document with something to see.

    class_id is the lowest key of all documents that look the same, text_id the lowest key of those
    with identical characters. Null, empty and invisible texts are in no row.
    """
    forms = _visible(docs, key, text)
    per_text = forms.groupBy("consistent_1", "consistent_2", "text_1", "text_2").agg(F.min(key).alias("text_id"))
    per_class = per_text.groupBy("consistent_1", "consistent_2").agg(F.min("text_id").alias("class_id"))
    named = per_text.join(per_class, ["consistent_1", "consistent_2"])
    return forms.join(named, ["consistent_1", "consistent_2", "text_1", "text_2"]).select(key, "class_id", "text_id")


def _visible(docs: DataFrame, key: str, text: str) -> DataFrame:
    forms = consistent_text(docs, key, text, readable=False)
    seen = forms.where(F.col("consistent").rlike(r"[^\s\p{Z}\p{Cc}]"))
    return seen.select(key, *_digest("consistent"), *_digest("text"))


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``{key}_a, {key}_b`` (smaller first) of documents that look the same but differ in characters.

    Every document of a class is paired with the representative (lowest key) of each other text
    of the class. Where no text has copies that is every pair; copies of one text are never paired
    with each other, and a copy meets another text through its representative, so the result
    grows with the documents and loses no link between different texts. Null, empty and
    invisible texts are no case; ``key`` must be unique.
    """
    forms = Scratch(docs.sparkSession).cut(_visible(docs, key, text), "forms")
    form = ["consistent_1", "consistent_2"]
    per_text = forms.groupBy(*form, "text_1", "text_2").agg(F.min(key).alias("rep"))
    several = per_text.groupBy(*form).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(*form)
    reps = per_text.join(several, form).select(*form, F.col("text_1").alias("r1"), F.col("text_2").alias("r2"), "rep")
    other = (F.col("text_1") != F.col("r1")) | (F.col("text_2") != F.col("r2"))
    return (
        forms.join(reps, form).where(other)
        .select(F.least(key, "rep").alias(f"{key}_a"), F.greatest(key, "rep").alias(f"{key}_b"))
        .distinct()
    )
