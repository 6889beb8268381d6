"""Exact, byte, word and line de-duplication against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from prosemill.llm import queries as Q
from prosemill.llm.lempel_ziv import ReferenceBlocks, remove_repeated_passages
from prosemill.llm.line_windows import remove_repeated_lines
from prosemill.llm.radix_dedup import duplicate_groups
from prosemill.llm.suffix_index import SuffixLevels, remove_repeated_bytes

sha = lambda b: hashlib.sha256(b).hexdigest()


def covered(sequences, length):
    """By sequence: a flag for each symbol that a repeated window covers."""
    seen = Counter(tuple(s[p : p + length]) if isinstance(s, list) else s[p : p + length] for s in sequences for p in range(len(s) - length + 1))
    for s in sequences:
        flags = bytearray(len(s))
        for p in range(len(s) - length + 1):
            if seen[tuple(s[p : p + length]) if isinstance(s, list) else s[p : p + length]] > 1:
                flags[p : p + length] = b"\x01" * length
        yield flags


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def passages(seed, n=60):
    """Documents of a small vocabulary with shared passages, so that windows of many lengths repeat."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 90))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return docs + [(n + i, ("ab " * (i * 7)).strip()) for i in range(8)]


@pytest.mark.parametrize("length", [7, 50, 400])
def test_repeated_bytes(spark, length):
    docs = passages(length)
    found = {r["doc_id"]: r for r in remove_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"), length).collect()}
    raw = [t.encode() for _, t in docs]
    for (i, _), text, flags in zip(docs, raw, covered(raw, length), strict=True):
        assert found[i]["kept"] == bytes(c for c, f in zip(text, flags, strict=True) if not f), i
        assert [(s["start"], s["end"]) for s in found[i]["spans"]] == [m.span() for m in re.finditer(b"\x01+", flags)]


@pytest.mark.parametrize("length", [3, 12, 35])
def test_repeated_words(spark, length):
    docs = passages(100 + length)
    found = {r["doc_id"]: r for r in remove_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), length).collect()}
    split = [t.split() for _, t in docs]
    for (i, _), words, flags in zip(docs, split, covered(split, length), strict=True):
        left = [w for w, f in zip(words, flags, strict=True) if not f]
        assert found[i]["kept_words"] == " ".join(left), i
        assert (found[i]["n_words"], found[i]["n_removed"]) == (len(words), sum(flags))
        assert found[i]["kept_text"].split() == left


@pytest.mark.parametrize("most", [0, 3])
def test_hot_heads_are_dealt_further(spark, monkeypatch, most):
    """most 0: every head is dealt down to its single windows."""
    from prosemill.llm import windows

    make = windows.Windows
    for module, run, length, kept in (("lempel_ziv", remove_repeated_passages, 12, "kept_words"), ("suffix_index", remove_repeated_bytes, 50, "kept")):
        docs = spark.createDataFrame(passages(5), "doc_id long, text string")
        usual = rows_of(run(docs, length), "doc_id", kept)
        with monkeypatch.context() as m:
            m.setattr(f"prosemill.llm.{module}.Windows", lambda *a: make(*a, most=most))
            assert rows_of(run(docs, length), "doc_id", kept) == usual


def long_texts():
    """Two texts over a segment of a mebibyte, with passages in common across the places where segments end."""
    rng = random.Random(8)
    words = [f"{rng.getrandbits(40):x}" for _ in range(130_000)]
    return [(1, " ".join(words)), (2, " ".join([*words[-60_000:-59_000], *(f"{rng.getrandbits(40):x}" for _ in range(110_000)), *words[90_000:120_000]])), (3, " ".join(words[5:60]))]


def test_long_texts_repeat_across_segments(spark):
    docs = long_texts()
    assert len(docs[0][1]) > 1 << 20 < len(docs[1][1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["kept"] for r in remove_repeated_bytes(df, 400).collect()}
    raw = [t.encode() for _, t in docs]
    for (i, _), text, flags in zip(docs, raw, covered_by_hash(raw, 400), strict=True):
        assert sha(found[i]) == sha(bytes(c for c, f in zip(text, flags, strict=True) if not f)), i
    found = {r["doc_id"]: r["kept_words"] for r in remove_repeated_passages(df, 35).collect()}
    split = [t.split() for _, t in docs]
    for (i, _), text, flags in zip(docs, split, covered_by_hash(split, 35), strict=True):
        assert sha(found[i].encode()) == sha(" ".join(w for w, f in zip(text, flags, strict=True) if not f).encode()), i


def covered_by_hash(sequences, length):
    """covered, with the digest of each window in the place of the window."""
    digest = lambda s: hashlib.blake2b(s if isinstance(s, bytes) else " ".join(s).encode(), digest_size=16).digest()
    prints = [[digest(s[p : p + length]) for p in range(len(s) - length + 1)] for s in sequences]
    seen = Counter(x for own in prints for x in own)
    for s, own in zip(sequences, prints, strict=True):
        flags = bytearray(len(s))
        for p, x in enumerate(own):
            if seen[x] > 1:
                flags[p : p + length] = b"\x01" * length
        yield flags


def test_many_rows_alike_in_id_and_text(spark):
    """A third of all rows may be one: its places are one array, not one for each pair of rows."""
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(None, text)] * 5000 + [(1, "other " + text), (2, "alone " * 3)], "doc_id long, text string")
    done = remove_repeated_passages(docs).groupBy("doc_id", "kept_words").count().collect()
    assert {(r["doc_id"], r["kept_words"], r["count"]) for r in done} == {(None, "", 5000), (1, "other", 1), (2, "alone alone alone", 1)}


def test_edges_of_bytes_and_words(edges, empty):
    for run, kept in ((remove_repeated_bytes, "kept"), (remove_repeated_passages, "kept_words")):
        done = run(edges)
        assert done.count() == edges.count() and run(empty).count() == 0
        by_id = {r["doc_id"]: r for r in done.collect()}
        assert len(by_id[1][kept]) == len(by_id[2][kept]) == 0
    by_id = {r["doc_id"]: r for r in remove_repeated_bytes(edges).collect()}
    assert by_id[10]["kept"] == by_id[11]["kept"] == b""
    assert [(s["start"], s["end"]) for s in by_id[9]["spans"]] == [(0, 6000)]
    words = {r["doc_id"]: r for r in remove_repeated_passages(edges).collect()}
    assert words[1]["kept_text"] is None and words[13]["kept_words"] == "before it after it"


def test_suffix_levels_keep_a_logarithmic_family():
    import numpy as np

    rng, length = random.Random(1), 12
    index, texts = SuffixLevels(length), []
    for _ in range(16):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(12, 90))).encode() + bytes(rng.choices(b"abc", k=40))
        texts.append(text)
        index.add(np.frombuffer(text, np.uint8), np.arange(len(text) - length + 1))
        sizes = [n for n, _ in index.levels]
        assert sizes == sorted(set(sizes), reverse=True) and all(n & (n - 1) == 0 for n in sizes)
        for _, level in index.levels:  # in the order of the suffixes' bytes, each string once
            whole = b"".join(texts)
            strings = [whole[p : p + length] for p in index.places[level]]
            assert strings == sorted(set(strings))
    windows = [t[p : p + length] for t in texts for p in range(len(t) - length + 1)]
    times = Counter(windows)
    assert index.matched.tolist() == [times[w] > 1 for w in windows]


def test_factors_run_across_blocks():
    blocks = ReferenceBlocks(3)
    assert blocks.parse("a b c d e".split()) == [] and blocks.parse("f g h i".split()) == []
    assert [(at, n) for at, _, _, n in blocks.parse("x c d e f g h i".split())] == [(1, 3), (4, 4)]


def test_exact_groups(spark, edges, empty):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    rows = texts_of(edges) + [(100 + i, ("p" * 63 + "q" * (i % 3)) * 40) for i in range(30)] + [(200 + i, "z" * (60 + i % 9)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = sorted(((i, max((k for k in groups[low(t)] if k is not None), default=None), len(groups[low(t)]), sha(low(t).encode())) for i, t in rows), key=str)
    done = duplicate_groups(docs)
    assert rows_of(done, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert done.where("kept").count() == len(groups)
    assert {(r["doc_id"], r["keep_id"]) for r in done.where("kept").collect()} == {(k, k) for k in (max((k for k in v if k is not None), default=None) for v in groups.values())}
    assert duplicate_groups(edges).count() == edges.count() and duplicate_groups(empty).count() == 0


def line_brute(rows, size=3):
    """Rows alike in id and text are one place."""
    first, places = {}, defaultdict(set)
    ordered = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in ordered:
        lines = t.split("\n") if t is not None else []
        for p in range(len(lines) - size + 1):
            window = tuple(lines[p : p + size])
            if first.setdefault(window, (i, t, p)) != (i, t, p):
                places[i, t] |= set(range(p, p + size))
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in places[i, t]), len(places[i, t])) for i, t in rows), key=str)


def test_lines(spark, edges, empty):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(remove_repeated_lines(docs), "doc_id", "kept_text", "n_removed") == line_brute(rows)
    assert rows_of(remove_repeated_lines(edges), "doc_id", "kept_text", "n_removed") == line_brute(texts_of(edges))
    assert remove_repeated_lines(empty).count() == 0


def test_line_query_runs_no_python(spark, small):
    plan = Q.op2_line_dedup(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_lines_that_overlap_a_later_occurrence_go(spark):
    """The window of four equal lines occurs again one line down: of the first occurrence its first line stays."""
    rows = [(1, "a\na\na\na"), (2, "x\ny\nz"), (3, "x\ny\nz\nx\ny\nz")]
    done = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(done, "doc_id", "kept_text", "n_removed") == [(1, "a", 3), (2, "x\ny\nz", 0), (3, "", 6)] == line_brute(rows)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from prosemill.llm.storage import shared_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
