"""The stages of the pipeline and run() against brute force, with null and repeated ids."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidekeep.llm import line_dedup, queries, similar
from tidekeep.llm.common import stored

DATA = "/root/testdata/sf0.001"
KNOWN = "a known line that stands at the head of several documents"


def clean():
    """Texts of one line that share nothing, made of the words of real documents."""
    rng = random.Random(4)
    words = sorted({w for t in pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()[:60] for w in t.split() if w.isalpha() and w.islower()})
    return [" ".join(rng.sample(words, 90)) + "." for _ in range(24)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A table where ids are null, repeated with different texts, or fine; with near copies and repeated lines."""
    texts = clean()
    rows = [(None, t) for t in texts[:8]] + [(7, t) for t in texts[8:13]] + [(100 + i, t) for i, t in enumerate(texts[13:19])]
    near = lambda t: " ".join(w if i not in (3, 60) else "elsewhere" for i, w in enumerate(t.split()))
    rows += [(None, near(texts[0])), (7, near(texts[1])), (200, near(texts[8])), (201, near(texts[13]))]
    # line 0 of one row without an id, and of one row of a repeated id, is known; line 0 of the others isn't
    rows += [(1, f"{KNOWN}\n{texts[19]}"), (None, f"{KNOWN}\n{texts[20]}"), (None, f"short\n{texts[21]}"), (9, f"{KNOWN}\n{texts[22]}"), (9, f"only here is this line of words\n{texts[23]}")]
    out = tmp_path_factory.mktemp("sf")
    cols = list(zip(*rows, strict=True))
    n = len(rows)
    table = pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": list(cols[1]), "lang": ["en"] * n, "source": [f"s{i % 2}" for i in range(n)], "n_chars": pa.array([len(t) for t in cols[1]], pa.int64())})
    pq.write_table(table, out / "documents.parquet")
    return str(out)


def order(place):
    """Smaller ids first, null ids last, then the place in the table."""
    i, at = place
    return (i is None, i or 0, at)


def brute_lines(rows):
    """Texts of rows (doc_id, text) without lines that repeat (two edits) a line of an earlier row or an earlier line."""
    seen, out = [], {}
    for at in sorted(range(len(rows)), key=lambda k: order((rows[k][0], k))):
        left = []
        for x in rows[at][1].split("\n"):
            y = x.strip(line_dedup.BLANK)
            if len(y) >= line_dedup.MIN_CHARS and any(line_dedup.distance(y, s, 2) <= 2 for s in seen):
                continue
            seen += [y] * (len(y) >= line_dedup.MIN_CHARS)
            left.append(x)
        out[at] = "\n".join(left)
    return sorted((str(rows[k][0]), t) for k, t in out.items() if t.strip())


def brute_groups(rows):
    """Groups of near copies, as lists of places in rows."""
    sets = [set(similar.shingle_set(t, 5).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    by = {}
    for i in range(len(rows)):
        by.setdefault(find(i), []).append(i)
    return list(by.values())


def least(rows, group):
    """The rows of a group that may stay: those of its smallest id."""
    ids = [rows[i][0] for i in group]
    first = min((i for i in ids if i is not None), default=None)
    return {rows[i] for i in group if rows[i][0] == first}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_near_dedup(spark, folder):
    docs = stored(spark.read.parquet(f"{folder}/documents.parquet"), "in")
    rows, got = pairs(docs), pairs(corpus_pipeline.near_dedup(spark, docs, folder))
    groups = brute_groups(rows)
    assert sum(len(g) > 1 for g in groups) == 4 and len(got) == len(groups)
    for g in groups:
        assert len([r for r in got if r in {rows[i] for i in g}]) == 1 and any(r in least(rows, g) for r in got)


def test_near_dedup_of_equal_rows(spark):
    made = spark.createDataFrame([(None, "the very same words in every row", "en", "a", 1)] * 5 + [(3, "", "en", "a", 0)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, pairs(corpus_pipeline.near_dedup(spark, stored(made, "in"), "")))) == sorted(map(str, [(None, "the very same words in every row"), (3, "")]))


def test_lines(spark, folder):
    docs = stored(spark.read.parquet(f"{folder}/documents.parquet"), "in")
    got = pairs(corpus_pipeline.lines(spark, docs, folder))
    assert sorted((str(i), t) for i, t in got) == brute_lines(pairs(docs))
    assert sum(t.startswith(KNOWN) for _, t in got) == 1 and sum(t.startswith(("short", "only here")) for _, t in got) == 2


def test_run(spark, folder):
    """Every group that the first three stages leave, by brute force, is packed, whole and at least once; nothing else is."""
    from tokenizers import Tokenizer

    kept = pairs(corpus_pipeline.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert len(kept) > 20 and sum(i is None for i, _ in kept) > 3 and sum(i == 7 for i, _ in kept) > 3
    rows = [(None if i == "None" else int(i), t) for i, t in brute_lines(kept)]
    encode = Tokenizer.from_file(queries.tokenizer()).encode
    size = lambda r: (r[0], len(encode(r[1], add_special_tokens=False).ids) + 1)
    want = [{size(r) for r in least(rows, g)} for g in brute_groups(rows)]
    packed = corpus_pipeline.run(spark, folder).collect()
    got = {(r.doc_id, r.doc_tokens) for r in packed}
    assert got <= set().union(*want) and all(got & w for w in want)
    assert sum(r.start == 0 for r in packed) >= len(want) and sum(r.length for r in packed) >= sum(min(n for _, n in w) for w in want)
