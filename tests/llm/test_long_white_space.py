"""Runs of white space of any length through the byte-level encoder and the packing of documents."""

import numpy as np
import public_tokenizers
import pytest
from fathomline.llm import packing
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", [
    " " * 3_000_000, "\n" * 3_000_000, "\t" * 3_000_000, " " * 3_000_000 + "word", "word" + "\n \t" * 1_000_000, "a " + " " * 9_998 + " b", "a" + "\n" * 9_999 + "b", "a" + "\n" * 10_000 + "b", "　" * 12_000 + "x"],
    ids=["spaces", "newlines", "tabs", "before a word", "mixed", "below", "just below", "at the bound", "wide"])
def test_ids_of_long_runs(text):
    got = np.frombuffer(packing.byte_bpe(BPE).ids(["some text", text, ""])[1], "<u4")
    assert got.tolist() == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_packing_of_long_runs(spark):
    docs = spark.createDataFrame([(1, "\n" * 2_000_000), (2, " " * 2_000_000 + "x"), (3, "plain")], "doc_id long, text string")
    rows = packing.pack_documents(docs, BPE).collect()
    want = {d: len(Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids) + 1 for d, t in docs.collect()}
    assert {d: sum(r.length for r in rows if r.doc_id == d) for d in want} == want
