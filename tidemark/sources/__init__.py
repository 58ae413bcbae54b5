"""Readers, normalisers and the observation ledger."""
