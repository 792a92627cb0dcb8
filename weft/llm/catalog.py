"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import ann, chat, html, lm, mixing, near_dup, packing, quality, secrets, wavelet

_MODULES = (mixing, packing, near_dup, quality, html, ann, chat, wavelet, lm, secrets)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
