"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("licenses", "toxicity", "lmscore", "langid", "quality", "decontam", "bpe", "neardup", "htmltext", "media", "whitening", "conversations", "tokenfile")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLES.items()}
