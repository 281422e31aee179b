"""SimHash, piecewise hashes and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import line_join, piecewise, queries, simhash
from tidemark.llm.common import components


def corpus(n: int, seed: int):
    """Texts with copies, near copies and shared lines."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        kind = pick.random()
        if out and kind < 0.2:
            text = pick.choice(out)
        elif out and kind < 0.5:
            words = (pick.choice(out) or "").split(" ")
            for _ in range(pick.randint(1, 3)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            text = " ".join(words)
        else:
            text = "\n".join(" ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 30))) for _ in range(pick.randint(1, 6)))
        out.append(text)
    return [(pick.randrange(10 * n) if i % 50 else i, t, f"extra{i}") for i, t in enumerate(out)]


EDGES = [(8, None, "a"), (3, "", "b"), (4, " \t\n", "c"), (None, "one two three four five", "d"), (6, "one two three four five", "e"),
         (6, "one two three four five", "e"), (7, "One  TWO three\tfour five", "f"), (9, "é" * 50_000, "g"), (10, "z " * 30_000, "h")]


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(rows):
    prints = [brute_simhash(r[1]) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[j] > label[i]:
                    label[j] = label[i]
                    changed = True
    least = {}
    for r, l in zip(rows, label):
        if r[0] is not None:
            least[l] = min(least.get(l, r[0]), r[0])
    return sorted(((r[0], p, least.get(l)) for r, p, l in zip(rows, prints, label)), key=str)


@pytest.mark.parametrize("rows", [corpus(120, 1), EDGES, [], [(None, "x", "y")]], ids=["corpus", "edges", "empty", "no_id"])
def test_simhash_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.simhash % 2**64, r.component_id) for r in found), key=str) == brute_components(rows)


def test_simhash_links_whatever_the_shards(spark, monkeypatch):
    """Chains of two-bit steps, with every shard dealt out by further bits."""
    pick = random.Random(4)
    values = {pick.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            v ^= 1 << pick.randrange(64) | 1 << pick.randrange(64)
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v, i) for i, v in enumerate(values)], "simhash long, node long")
    want = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= 2 and want[j] > want[i]:
                    want[j], changed = want[i], True
    for limit in (20_000, 1):
        monkeypatch.setattr(simhash, "SHARD", limit)
        label = {r.node: r.component for r in components(simhash.near_links(nodes)).collect()}
        assert [label.get(i, i) for i in range(len(values))] == want


def test_bk_forest_finds_all_within_the_radius():
    random_ = np.random.default_rng(1)
    values = random_.integers(0, 1 << 10, 300).astype(np.uint64)
    shard = np.sort(random_.integers(0, 5, 300))
    for radius in (0, 1, 2, 3):
        found = {(int(a), int(b)) for part in simhash.BKForest(shard, values).links(radius) for a, b in zip(*part)}
        assert found == {(i, j) for i in range(300) for j in range(300) if i != j and shard[i] == shard[j] and int(values[i] ^ values[j]).bit_count() <= radius}


def test_keep_first_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f", 1), (2, "a b c d e f", 1), (9, "other words here now", 1), (None, "a b c d e f", 1)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, x int"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9] and kept.columns == ["doc_id", "text", "x"]
    repeated = simhash.keep_first(spark.createDataFrame([*rows, *rows, (9, "not the same at all then", 1)], "doc_id long, text string, x int"))
    assert sorted(r.doc_id for r in repeated.collect()) == [2, 9, 9]
    without = simhash.keep_first(spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 1)], "doc_id long, text string, x int"))
    assert without.count() == 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(own) // 4
        edited = own[:len(own) - cut] + after[:cut]
        out.append((r[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), piecewise.fingerprint(own), piecewise.fingerprint(edited)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [corpus(90, 2), EDGES, [], [(1, "alone in here", "x")], [(None, "b", "x"), (None, "a", "x")]], ids=["corpus", "edges", "empty", "one", "no_ids"])
def test_edited_texts(spark, rows):
    found = piecewise.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == brute_edited(rows)
    assert all(0 <= v <= 1 for r in found.collect() for v in (r.near_edited, r.near_next))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_likeness(spark):
    pick = random.Random(3)
    base = " ".join(f"word{pick.randrange(900)}" for _ in range(800))
    far = " ".join(f"word{pick.randrange(900)}" for _ in range(800))
    near = base[:2000] + "changed" + base[2010:]
    marks = {k: piecewise.fingerprint(t) for k, t in {"base": base, "far": far, "near": near, "empty": "", "half": base[:len(base) // 2]}.items()}
    frame = spark.createDataFrame([tuple(marks.values())], list(marks))
    c = {k: F.col(k) for k in marks}
    row = frame.select(*[piecewise.likeness(c["base"], c[k]).alias(k) for k in marks]).first()
    assert row.base == 1 and row.near > 0.9 and row.far < 0.3 and row.empty == 0 and 0.3 < row.half < 0.7
    size, first, second = marks["base"].split(":")
    assert size == marks["near"].split(":")[0]
    best = max(1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in zip((first, second), marks["near"].split(":")[1:]))
    assert row.near == pytest.approx(best)


def test_fingerprint_bounds():
    for text in ("", "a", "a" * 100_000, "ab" * 30_000, "é" * 70, "".join(map(chr, range(32, 1000)))):
        mark = piecewise.fingerprint(text)
        assert mark == piecewise.fingerprint(text)
        assert all(len(s) <= 65 for s in mark.split(":")[1:])


def brute_lines(rows, t=0.8, least=1):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = [], {}
    for i in order:
        text = rows[i][1]
        lines = [] if text is None else text.split("\n")
        gone = []
        for k, line in enumerate(lines):
            words = frozenset(line.encode().lower().split())
            if len(words) < least:
                continue
            if any(len(words & s) / len(words | s) >= t - 1e-9 for s in seen):
                gone.append(k)
            seen.append(words)
        out[i] = (rows[i][0], None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), rows[i][2], len(lines), gone)
    return sorted(out.values(), key=str)


LINES = EDGES + [(20, "one two three four five six seven eight nine\nshort line", "i"), (21, "x\none two three four five six seven eight ten nine\n\nshort line\n", "j"), (22, "a b c d e\na b c d e\nA  b c e d", "k")]


@pytest.mark.parametrize("rows", [corpus(150, 5), LINES, []], ids=["corpus", "edges", "empty"])
def test_lines_equal_brute_force(spark, rows):
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, body string, n_lines string").coalesce(1)
    found = line_join.dedup(frame)
    assert found.columns == ["doc_id", "text", "body", "n_lines", "removed"]
    got = sorted(((r.doc_id, r.text, r.body, r.n_lines, r.removed) for r in found.collect()), key=str)
    assert got == brute_lines(rows)


def test_lines_in_many_chunks_and_blocks(spark, monkeypatch):
    rows = corpus(150, 6)
    ids = [(2 * i + 1, t, x) for i, (_, t, x) in enumerate(rows)]
    monkeypatch.setattr(line_join, "CHUNK", 300)
    monkeypatch.setattr(line_join, "BUCKET", 200)
    monkeypatch.setattr(line_join, "FAMILY", 2)
    monkeypatch.setattr(line_join, "ROWS", 50)
    monkeypatch.setattr(line_join, "FREQUENT", 64)
    found = line_join.dedup(spark.createDataFrame(ids, "doc_id long, text string, body string").repartition(4))
    got = sorted(((r.doc_id, r.text, r.body, r.n_lines, r.removed) for r in found.collect()), key=str)
    assert got == brute_lines(ids)


SHORT = [(1, "one two three four\nyes\n\nno no", "a"), (2, "Yes\nno\none two three four five\na b c", "b"), (3, "c b a\na b\nb a\na b c d\n \t", "c"),
         (None, "yes\nz z z z z z", "d"), (5, "one two\nz", "e"), (6, None, "f"), (7, "three four two one", "g")]


@pytest.mark.parametrize("rows", [SHORT, LINES, corpus(100, 7)], ids=["short", "edges", "corpus"])
def test_short_lines_take_part(spark, rows, monkeypatch):
    monkeypatch.setattr(line_join, "CHUNK", 5)
    found = line_join.dedup(spark.createDataFrame(rows, "doc_id long, text string, body string").coalesce(1), least_words=1)
    got = sorted(((r.doc_id, r.text, r.body, r.n_lines, r.removed) for r in found.collect()), key=str)
    assert got == brute_lines(rows, least=1)


def test_line_query_takes_short_lines(spark, tmp_path):
    spark.createDataFrame(SHORT, "doc_id long, text string, body string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op5_line_join(spark, str(tmp_path))
    assert {r.doc_id: r.removed for r in found.collect()} == {r[0]: r[4] for r in brute_lines(SHORT, least=1)}


def near_text(text, tries=200_000):
    """A text of another fingerprint at most two bits away."""
    pick = random.Random(8)
    base = brute_simhash(text)
    words = text.split(" ")
    for _ in range(tries):
        changed = list(words)
        changed[pick.randrange(len(words))] = f"n{pick.randrange(1 << 30)}"
        if 0 < (simhash.fingerprint(" ".join(changed)) ^ base).bit_count() <= 2:
            return " ".join(changed)
    raise AssertionError("no near text")


LONG = " ".join(f"word{i}" for i in range(400))


def test_keep_first_judges_rows_not_ids(spark):
    near = near_text(LONG)
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "clean and alone here"), (None, "another clean one"),
            (7, "a b c d e f"), (7, "not like any other text"), (8, LONG), (8, near), (None, None), (None, "")]
    kept = {(r.doc_id, r.text or "") for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept - {(8, LONG), (8, near)} == {(1, "a b c d e f"), (None, "clean and alone here"), (None, "another clean one"),
                                            (7, "not like any other text"), (None, "")}
    assert len(kept) == 6


def test_rows_without_an_id_link(spark):
    near = near_text(LONG)
    rows = [(5, LONG, ""), (None, near, ""), (9, "other words", "")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()
    assert sorted(((r.doc_id, r.simhash % 2**64, r.component_id) for r in found), key=str) == brute_components(rows)
    assert {r.doc_id: r.component_id for r in found} == {5: 5, None: 5, 9: 9}


def test_hot_words_meet_in_blocks(spark, monkeypatch):
    """Lines of one template with one or two own words: no task gets all postings of its rarest word."""
    pick, template = random.Random(9), "the quick brown fox jumps over lazy dogs today"
    rows = [(i, f"{template.rsplit(' ', own - 1)[0]} " + " ".join(f"own{i if pick.random() < 0.9 else i // 2}x{k}" for k in range(own)), "x")
            for i in range(240) for own in (1 + (i % 3 > 0),)] + [(500, " ".join(template.split()[:8]), "x"), (600, template, "x")]
    for name, value in (("CHUNK", 50), ("BUCKET", 40), ("NAMED", 1), ("FREQUENT", 64)):
        monkeypatch.setattr(line_join, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string").coalesce(1)
    got = sorted(((r.doc_id, r.text, r.body, r.n_lines, r.removed) for r in line_join.dedup(docs, least_words=1).collect()), key=str)
    assert got == brute_lines(rows, least=1)
    chunks = line_join.written(docs.mapInArrow(line_join._chunks(0.8, 1), line_join._CHUNK))
    met = {}
    for r in line_join._posted(chunks, 0.8, 1).collect():
        met[r.bucket] = met.get(r.bucket, 0) + len(line_join.unpack(bytes(r.line)))
    assert max(met.values()) <= 3 * line_join.BUCKET


def test_rows_without_an_id_are_dealt_over_ranges(spark, monkeypatch):
    """A third of all rows has no id, a third one id: no range has far more than its part."""
    monkeypatch.setattr(piecewise, "partitions", lambda _: 8)
    pick = random.Random(4)
    texts = ["".join(pick.choice("abcdef ") for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = []
    real = piecewise._pairs

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": [batch.num_rows], "n_chars": [sum(batch.column("guest").to_pylist())], **{c: [""] for c in (
                    "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")}})

    monkeypatch.setattr(piecewise, "_pairs", counted)
    sizes = [(r.doc_id, r.n_chars) for r in piecewise.edited_fingerprints(frame).select("doc_id", "n_chars").collect()]
    assert sum(n - g for n, g in sizes) == 3000 and max(n for n, _ in sizes) < 900 and sum(g for _, g in sizes) < 30
    monkeypatch.setattr(piecewise, "_pairs", real)
    order = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "n long, text string").withColumn("mark", F.xxhash64("text"))
    marks = {r.n: r.mark for r in order.collect()}
    places = sorted(range(3000), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, marks[i]))
    follower = {i: texts[places[(k + 1) % 3000]] for k, i in enumerate(places)}
    want = sorted((str(rows[i][0]), hashlib.sha256((t[:len(t) - len(t) // 4] + follower[i][:len(t) // 4]).encode()).hexdigest()) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in piecewise.edited_fingerprints(frame).select("doc_id", "edited_sha256").collect()) == want


def test_only_lines_that_may_start_with_a_last_word_are_counted():
    """Words that are no candidates for hot ones spare the lines whose prefix they fill."""
    texts = [" the of\n\nthe of a the\nx1 x2 x3 the of a\nthe the the\ny y y y the of", None, "", "the of a in to x1\nx1 x1 x2 x1 the of a in to is"]
    lines = line_join._Lines(pa.array(texts), 1)
    common = line_join._hashes(pa.array(["the", "of", "a", "in", "to", "is"]))
    last = np.isin(lines.hashes, common)
    priority = np.where(last, np.uint64(1) << np.uint64(63), np.uint64(0)) + (lines.hashes >> np.uint64(1))
    asked = line_join._may_hold(lines, last, 0.8)

    def postings(asked=None):
        word, start, size, kept = lines.sets(priority, asked)
        first = [word[s:s + n] for s, n in zip(start, line_join._prefix(size, 0.8))]
        return sorted((int(lines.line[k]), int(w)) for k, words in zip(kept, first) for w in words if last[w])

    assert postings(asked) == postings() != []
    assert not asked[list(lines.line).index(3)] and asked.sum() < len(lines.line)


def test_words_of_lines_equal_plain_ones():
    """White space, words over the ends of texts, words beyond eight bytes, parts of an array, lines asked for."""
    pick = random.Random(3)
    signs = [*"abcAZ\0", "é", "\x85", "\x1c", "word-of-more-bytes", "Word-of-more-bytes", *" \t\n\n\v\f\r"]
    for _ in range(200):
        texts = [None if pick.random() < 0.2 else "".join(pick.choices(signs, k=pick.randrange(12))) for _ in range(pick.randrange(2, 8))]
        asked = [line for t in texts[1:] if t is not None for line in t.split("\n")]
        only = np.array(sorted(pick.sample(range(len(asked)), len(asked) // 2)), np.int64)
        want = [[w for w in re.split("[ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)) if w] for line in asked]
        for places in (None, only):
            lines = line_join._Lines(pa.array(texts, pa.string()).slice(1), 1, places)
            word, start, size, kept = lines.sets()
            got = {int(lines.line[k]): set(lines.hashes[word[s:s + n]].tolist()) for k, s, n in zip(kept, start, size)}
            taken = [i for i in (range(len(asked)) if places is None else places.tolist()) if want[i]]
            assert got == {i: set(line_join._hashes(pa.array(want[i])).tolist()) for i in taken}
    words = ["", *sorted({"".join(pick.choices("ab\0é", k=n)) for n in range(1, 20) for _ in range(50)})]
    assert len(set(line_join._hashes(pa.array(words)).tolist())) == len(words)


def test_rarer_words_are_ordered_by_count(spark):
    """A word that is one in 150,000 comes before one that is one in 100,000 and after those hardly ever there."""
    words = ["common"] * 299_994 + ["twice"] * 2 + ["thrice"] * 3 + ["once"]
    docs = spark.createDataFrame([(1, "\n".join(" ".join(words[i::1000]) for i in range(1000)))], "doc_id long, text string")
    chunks = line_join.written(docs.mapInArrow(line_join._chunks(0.8, 1), line_join._CHUNK))
    frequent, most, others = line_join._frequent(chunks)
    assert frequent.tolist() == line_join._hashes(pa.array(["twice", "thrice", "common"])).tolist()
    assert (most >= [2, 3, 299_994]).all() and others >= 1


def test_links_of_a_bucket_equal_brute_force(monkeypatch):
    """Sizes and bitmaps sorted as parts of one number, pairs of lines linked before left out."""
    pick = random.Random(12)
    base = [" ".join(f"w{pick.randrange(40)}" for _ in range(pick.choice([1, 2, 3, 5, 30, 120]))) for _ in range(60)]
    texts = [" ".join(w if pick.random() < 0.95 else f"x{pick.randrange(9)}" for w in t.split()) for t in base * 3]
    for name, value in (("FREQUENT", 64), ("WIDE", 20)):
        monkeypatch.setattr(line_join, name, value)
    monkeypatch.setattr(line_join, "chunk_numbers", lambda: iter(range(9)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    chunk = next(line_join._chunks(0.8, 1)(iter([batch])))
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    rows = pa.Table.from_batches(line_join._postings(np.zeros(0, np.uint64), 1, none, 0.8, 1)(iter([chunk])))
    links = line_join._candidates(0.8)((0,), rows).to_pylist()
    family = {link["a"] & 0xFFFFFF: link["b"] & 0xFFFFFF for link in links}
    sets = [set(t.split()) for t in texts]
    twins = set(line_join.unpack(chunk.column("twins")[0].as_py()).tolist())
    for i, a in enumerate(sets):
        for j in range(i):
            if {i, j}.isdisjoint(twins) and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                assert family.get(i, i) == family.get(j, j)
