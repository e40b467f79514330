"""Lines above the limit leave the texts."""

from collections import Counter

import pytest
from test_llm import prose

from marginalia.llm import line_quality

LIMIT = line_quality.MAX_DOCUMENTS


@pytest.mark.parametrize("operator", [line_quality.remove_lines, line_quality.keep_good])
def test_lines_removed(spark, operator):
    notice = "Subscribe to our letter 7 now"
    body = lambda i: f"{prose(i, 30)}\n\n  {prose(1000 + i, 15)}"
    many = [(i, f"{notice}\n{body(i)}\n{notice.upper()}\n", "h", "x") for i in range(LIMIT + 5)]
    rows = [*many, many[7], (200, notice + "\n" + prose(5000, 2), "h", "x"), (None, f"{notice}\n{body(900)}", "h", "x"), (201, f"{notice}\n{body(901)}", "other", "x"), (203, f"{notice}\n{body(902)}", None, "x")]
    # copies are documents too: only the first keeps its lines, and the others are depleted
    rows += [(300 + i, f"again and again\n{body(903)}", "h2", "x") for i in range(LIMIT + 5)]
    # rows of one id are one document
    rows += [(400, f"once and for all\n{body(904)}", "h3", "x")] * (LIMIT + 5)
    got = operator(spark.createDataFrame(rows, "doc_id long, text string, source string, gone string"))
    want = Counter()
    for i, text, host, more in rows:
        if i == 200 or i is not None and 300 < i < 400:
            continue
        if host == "h" and i is not None:  # the null id is the smallest
            text = "\n".join(x for x in text.split("\n") if x.lower() != notice.lower())
        want[i, text, host, more] += 1
    assert got.columns == ["doc_id", "text", "source", "gone"] and Counter(map(tuple, got.collect())) == want


def test_null_text(spark):
    rows = [(1, None, None), (2, "", "h"), (2, "", "h")]
    assert Counter(map(tuple, line_quality.remove_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())) == Counter(rows)
