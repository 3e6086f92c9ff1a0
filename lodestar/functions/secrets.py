"""Secrets in texts. The patterns are this library's own, one for each kind."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
# kind: a pattern that Java and RE2 read alike
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----",
    "openai": r"\bsk-[A-Za-z0-9_-]{20,}",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{30,}",
    "aws": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "stripe": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "database": r"\b(?:postgres|postgresql|mysql|mongodb|redis)://[^\s:@/]+:[^\s@/]+@[^\s\"]+",
    "assignment": r"(?:token|secret|api_key|password)\s*=\s*\"?[A-Za-z0-9_/+-]{12,}\"?",
}


# Texts of which a match of the kind has at least one. The mark has none of them, nor parts of them at its ends, so
# what earlier patterns leave has no more of them than the text.
HINTS = {
    "private_key": ("-----BEGIN ",),
    "openai": ("sk-",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "aws": ("AKIA", "ASIA"),
    "stripe": ("k_live_", "k_test_"),
    "jwt": ("eyJ",),
    "database": ("://",),
    "assignment": ("token", "secret", "api_key", "password"),
}


def suspected(text: Column) -> Column:
    """Whether a text may have secrets: whether it has a hint and, of the kind of one that it has, a match."""
    kinds = (reduce(or_, (F.contains(text, F.lit(h)) for h in hints)) & F.regexp_like(text, F.lit(PATTERNS[kind])) for kind, hints in HINTS.items())
    return reduce(or_, kinds)


def redact(text: Column) -> Column:
    """Patterns are looked at in their order, and only in texts that one of them matches."""
    return F.when(suspected(text), reduce(lambda t, p: F.regexp_replace(t, p, MARK), PATTERNS.values(), text)).otherwise(text)


def count(text: Column) -> Column:
    """Secrets that redact would replace: those of later patterns are counted in what earlier ones left."""
    total, left = F.lit(0), text
    for p in PATTERNS.values():
        total = total + F.regexp_count(left, F.lit(p))
        left = F.regexp_replace(left, p, MARK)
    return F.when(suspected(text), total.cast("long")).when(text.isNotNull(), F.lit(0).cast("long"))
