"""Which rows stay of groups of near copies."""

from collections import Counter

import pytest
from helpers import docs

from matchwright.llm import simhash


@pytest.mark.parametrize("words", [4, 5])
def test_clean_rows_stay_whatever_their_id(spark, words):
    def text(seed):
        return " ".join(f"{seed}w{i}" for i in range(60))

    table = [(None, text("a"), "s"), (None, text("b"), "s"), (None, text("c"), "s"), (None, text("c"), "s"),
             (3, text("d"), "s"), (5, text("d"), "s"), (5, text("e"), "s"), (5, text("f"), "s"), (None, text("f"), "s")]
    left = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs(spark, table), words=words).collect())
    assert left == Counter([(None, text("a")), (None, text("b")), (None, text("c")), (3, text("d")), (5, text("e")), (5, text("f"))])
