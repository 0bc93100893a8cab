"""The registered queries do the whole job."""
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from soundgrid.llm import bpe, lines, queries
from soundgrid.llm.queries import VOCABULARY

from odd_rows import ODD  # noqa: I001

ROOT = "/root/testdata/sf0.001"


def test_training_order_holds_token_ids(spark, docs):
    rows = [(10, "Some words, émigré 😀 and\nmore"), *ODD]
    wide = bpe.encode_wide(docs(rows), VOCABULARY).collect()
    ids = bpe.encode(docs(rows), VOCABULARY).collect()
    assert [np.frombuffer(r["ids"], "<u2").tolist() for r in wide] == [r["ids"] for r in ids]
    tokens = {r["doc_id"]: r["n"] for r in queries.op3_bpe(spark, ROOT).select("doc_id", F.col("n_tokens").alias("n")).collect()}
    made = Counter()
    for r in queries.op5_training_order(spark, ROOT).collect():
        made[r["doc_id"]] += r["n_tokens"]
    assert made == tokens


def test_short_lines_that_repeat_exactly_go(docs):
    rows = [(1, "Menu\nHome\n\n  \na line of its own that is long"), (2, "Menu \nHomes\n\nmenu"), (3, "Menu")]
    made = sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup(docs(rows)).collect())
    assert made == [(1, rows[0][1], 0), (2, "Homes\n\nmenu", 1), (3, "", 1)]
