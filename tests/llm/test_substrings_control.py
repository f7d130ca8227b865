"""op3 on texts with control characters inside words: only 0x20 and 0x09-0x0D are white space."""

import random
import re

import pytest

pytest.importorskip("docflow.llm")

from docflow.llm import substrings  # noqa: E402

R = random.Random(11)


def test_control_characters_are_of_words(spark):
    word = lambda: "".join(R.choice("abc\x00\x01\x08\x0e\x1b\x1f") for _ in range(5))
    passage = [word() for _ in range(50)]
    texts = [" ".join([*(word() for _ in range(R.randrange(12))), *passage[R.randrange(20) :], *(word() for _ in range(9))]) for _ in range(30)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        covered = set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                covered.update(range(s, s + 20))
            seen.add(window)
        want[i] = (" ".join(x for k, x in enumerate(w) if k not in covered), len(w), len(covered))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect()}
    assert got == want
