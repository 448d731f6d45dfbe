import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from objtrail.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[t or ""] if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_groups_ties_nulls_and_long_texts(docs):
    long = "x" * 100_000
    rows = [(1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (6, long + "y"), (7, long + "z"), (8, long + "y")]
    rows += [(9, "é"), (9, "é"), (10, "é"), (None, "a"), (None, "alone"), (11, long)] + [(100 + i, "hot") for i in range(200)]
    assert got(exact_dedup(docs(rows))) == brute(rows)


def test_depths_do_not_matter(docs):
    rows = [(i, ("ab" * (i % 7)) + ("c" if i % 3 else "")) for i in range(60)]
    assert got(exact_dedup(docs(rows), first_depth=1, growth=2)) == brute(rows)


def test_empty_table(docs):
    assert exact_dedup(docs([])).collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\n€", max_size=6), max_size=25))
def test_any_texts(docs, texts):
    rows = list(enumerate(texts))
    assert got(exact_dedup(docs(rows), first_depth=2, growth=2)) == brute(rows)
