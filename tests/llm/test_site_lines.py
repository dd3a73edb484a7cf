from collections import Counter, defaultdict

import pytest

from quirelake.llm.site_lines import drop_site_lines


def brute(rows, share, least):
    pages, held = Counter(), defaultdict(Counter)
    has = lambda x: x.strip(" \t\r\x0b\x0c") != ""
    for _, t, _, s, _ in rows:
        pages[s or ""] += 1
        held[s or ""].update({x for x in (t or "").split("\n") if has(x)})
    out = []
    for d, t, _, s, _ in rows:
        kept = [x for x in (t or "").split("\n") if not (has(x) and held[s or ""][x] >= least and held[s or ""][x] > share * pages[s or ""])]
        out.append((str(d), None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("share,least", [(0.02, 2), (0.05, 5), (0.5, 2)])
def test_against_brute_force(docs, fixture_rows, share, least, broadcast):
    got = [
        (str(r["doc_id"]), r["text"], r["n_lines"]) for r in drop_site_lines(
            docs, most_share=share, least_pages=least, most_broadcast=broadcast
        ).collect()
    ]
    assert sorted(got, key=str) == brute(fixture_rows, share, least)


def test_empty_and_clashing(no_docs, clashing):
    assert drop_site_lines(no_docs).count() == 0
    out = drop_site_lines(clashing)
    assert out.columns.count("n_lines") == 1 and {"host", "line"} <= set(out.columns) and out.count() == clashing.count()


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_copies_of_a_page_are_not_boilerplate(spark, broadcast):
    copy = "a page of its own\nwith two lines"
    rows = [(i, copy, "h") for i in range(40)] + [
        (100 + i, f"menu of the site\ntext {i}", "h") for i in range(20)
    ] + [(200, None, "h"), (201, "", None)]
    got = {
        r["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_site_lines(
            spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), most_broadcast=broadcast, distinct_pages=True
        ).collect()
    }
    assert all(got[i] == (copy, 0) for i in range(40)) and all(got[100 + i] == (f"text {i}", 1) for i in range(20))
    assert got[200] == (None, 0) and got[201] == ("", 0)
