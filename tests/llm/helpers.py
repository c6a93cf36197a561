"""Small tables and plain versions for the tests of the corpus operators."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Texts with what is easy to get wrong.
ODD_TEXTS = [
    None, "", " ", "\n\t ", "a", "!!!", "'s", "it's  he'll'd 'tis ''s !'s  \n\t's a's's 'rest", "  lead", "trail  ", "x<|endoftext|>y <|startoftext|>", "İstanbul ΣΑΣ é é Ⅷ ² ½",
    "日本語 テスト１２３ 한국어", "🙂👨‍👩‍👧 ok!!", "\x00\x01 \x85a", "a\r\nb", "123 45'6's", "word " * 3000, "x" * 5000, "same text here again", "same text here again",
]


def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def library_ids(path: str, texts) -> list[list[int]]:
    t = library(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def documents(spark, texts, ids=None, extra=True):
    """A documents table; ``extra`` adds columns whose names clash with what operators produce."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "x", 1, None) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEEP_ID string, slot int, Score double")
    return df if extra else df.select("doc_id", "text")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))
