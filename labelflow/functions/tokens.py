"""Fixed-length tokenisation of residue strings and masked-LM inputs (Column expressions).

Fixed vocabulary (ours): pad 0, bos 1, eos 2, unk 3, mask 4, residues 5.. in alphabet order
("-ACDEFGHIKLMNPQRSTVWY" -> 5..25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow.constants import ALPHABET, Q

PAD, BOS, EOS, UNK, MASK = 0, 1, 2, 3, 4
OFFSET = 5
VOCAB = OFFSET + Q


def residue_ids(seq: str) -> Column:
    """Token ids of the residues (no specials); unknown letters -> UNK; empty string -> []."""
    return F.expr(f"if(length(`{seq}`) = 0, array(), transform(split(`{seq}`, ''), "
                  f"c -> if(instr('{ALPHABET}', c) = 0, {UNK}, instr('{ALPHABET}', c) + {OFFSET - 1})))")


def tokenize_fixed(seq: str, max_length: int) -> tuple[Column, Column]:
    """(input_ids, attention_mask) = [bos] + residues truncated to max_length-2 + [eos], padded
    with pad to max_length; mask 1 on real tokens."""
    # counts come from the string's length: an expression of the ids inside a lambda is computed again for every position
    n = F.when(F.length(seq) > max_length - 2, max_length - 2).otherwise(F.length(seq)) + 2
    body = F.slice(residue_ids(seq), 1, max_length - 2)
    padded = F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)), F.array_repeat(F.lit(PAD), F.lit(max_length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return padded, mask
