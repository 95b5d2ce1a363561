"""Column expressions on residue strings and code arrays (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow.constants import ALPHABET, GAP, NON_ALPHABET_LETTERS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def residue_letters(text) -> Column:
    """Upper-case ASCII letters of a text, letters outside the alphabet mapped to the gap."""
    letters = F.upper(F.regexp_replace(_c(text), "[^A-Za-z]+", ""))
    return F.translate(letters, NON_ALPHABET_LETTERS, GAP * len(NON_ALPHABET_LETTERS))


def space_residues(seq) -> Column:
    """"ACD" -> "A C D"."""
    return F.array_join(F.split(_c(seq), ""), " ")


def encode_residues(seq, alphabet: str = ALPHABET) -> Column:
    """letter -> 0-based index in the alphabet (-1 if absent)."""
    return F.expr(f"transform(split({_sql(seq)}, ''), ch -> instr('{alphabet}', ch) - 1)")


def decode_residues(codes, alphabet: str = ALPHABET) -> Column:
    """code array -> string."""
    return F.expr(f"array_join(transform({_sql(codes)}, i -> substr('{alphabet}', i + 1, 1)), '')")


def strip_gaps(seq) -> Column:
    """remove gap symbols."""
    return F.replace(_c(seq), F.lit(GAP), F.lit(""))


def sequence_identity(a, b) -> Column:
    """fraction of aligned positions with equal symbols (gap-gap counts as a match)."""
    sa, sb = _sql(a), _sql(b)
    return F.expr(
        f"aggregate(zip_with(split({sa}, ''), split({sb}, ''), (x, y) -> if(x = y, 1, 0)), 0, (s, v) -> s + v)"
        f" / length({sa})")


def fasta_header_id(line) -> Column:
    """first whitespace-separated token of a FASTA description line (without '>')."""
    return F.element_at(F.split(F.regexp_replace(F.trim(_c(line)), "^>", ""), r"\s+", 2), 1)


def label_one_hot(idx, n_classes: int) -> Column:
    """F16: dense one-hot array of a label index."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == _c(idx)).cast("int"))


def md5_uniform(seed: int, *cols) -> Column:
    """Deterministic uniform in [0,1) from md5("seed:c1:c2..."): first 8 hex digits / 16^8.
    Depends only on the key, never on partitioning, so re-runs and retries agree."""
    key = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(16 ** 8)


def _sql(x) -> str:
    if isinstance(x, str):
        return f"`{x}`"
    raise TypeError("pass a column name for SQL-expression helpers")
