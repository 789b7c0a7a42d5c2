"""Line dedup, decontamination, packing and the pipeline against plain recomputation."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_fixtures import SF_DIR, docs_of, empty, odd, table  # noqa: F401  (fixtures)
from rolltally.llm import decontaminate, lines, packing, queries, toxicity
from rolltally.llm.common import give_back


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def stripped(line):
    return line.strip(" \t\n\x0b\x0c\r")


def plain_lines(docs, edits=lines.EDITS, near_chars=lines.NEAR_CHARS):
    first, count = {}, {}
    order = sorted({(d is None, d or 0, t or "") for d, t in docs})
    for without, doc, text in order:
        for k, line in enumerate(text.split("\n")):
            if stripped(line):
                place = (without, doc, k)
                first[stripped(line)] = min(first.get(stripped(line), place), place)
    near = {x: [] for x in first}
    by_length = {}
    for x in first:
        by_length.setdefault(len(x), []).append(x)
    for x in first:
        for n in range(len(x), len(x) + edits + 1):
            for y in by_length.get(n, ()):
                if x < y or len(x) < len(y):
                    if x != y and min(len(x), len(y)) >= near_chars and abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits:
                        near[x].append(y)
                        near[y].append(x)
    return first, near


def add_near_in_words(first, near):
    """Pairs that a tenth of the longer line's words, edited, tells apart; bags of words rule most out."""
    cut = {x: [w for w in re.split("[ \t\n\x0b\x0c\r]+", x)] for x in first}
    bags = {x: Counter(w) for x, w in cut.items()}
    ordered = sorted(first, key=lambda x: len(cut[x]))
    for i, x in enumerate(ordered):
        for y in ordered[i + 1 :]:
            longer = len(cut[y])
            allowed = longer // lines.WORDS_AN_EDIT
            if longer - len(cut[x]) > longer // 9 + 1:
                break
            if allowed and longer - len(cut[x]) <= allowed and longer - (bags[x] & bags[y]).total() <= allowed and y not in near[x]:
                if edit_distance(cut[x], cut[y]) <= allowed:
                    near[x].append(y)
                    near[y].append(x)


def plain_result(docs, by_words=False):
    first, near = plain_lines(docs)
    if by_words:
        add_near_in_words(first, near)
    out = Counter()
    for doc, text in docs:
        if text is None:
            out[(doc, 0, 0, 0, None)] += 1
            continue
        n = removed = links = 0
        kept = []
        for k, line in enumerate(text.split("\n")):
            x = stripped(line)
            if not x:
                kept.append(line)
                continue
            n += 1
            at = (doc is None, doc or 0, k)
            links += len(near[x]) if first[x] == at else 0
            if first[x] == at and not any(first[y] < at for y in near[x]):
                kept.append(line)
            else:
                removed += 1
        out[(doc, n, removed, links, "\n".join(kept))] += 1
    return out


def found_lines(spark, docs):
    found = lines.dedup_lines(spark, docs).select("row.doc_id", "n_lines", "n_removed", "n_links", "kept_text")
    return Counter(tuple(r) for r in found.collect())


def test_lines_equal_all_pairs(spark, docs_of):
    random.seed(3)
    base = ["".join(random.choices("abcd efgh", k=random.randrange(14, 60))) for _ in range(60)]

    def edited(x):
        for _ in range(random.randrange(4)):
            k = random.randrange(len(x) + 1)
            x = random.choice([x[:k] + "z" + x[k:], x[:k] + x[k + 1 :], x[:k] + "é漢"[random.randrange(2)] + x[k + 1 :]])
        return x

    docs = []
    for i in range(150):
        text = "\n".join(random.choice([edited(random.choice(base)), random.choice(base), "", " \t"]) for _ in range(random.randrange(6)))
        docs.append((random.choice([i, i, None]) if i % 9 == 0 else i, text, "en", "s", 0))
    # Documents without an id order among themselves by a key only; one is enough here.
    seen_null = False
    docs = [d for d in docs if d[0] is not None or not seen_null and (seen_null := True)]
    assert found_lines(spark, docs_of(docs).repartition(3)) == plain_result([(d[0], d[1]) for d in docs])


def test_line_groups_in_blocks(spark, docs_of):
    random.seed(4)
    lead = "the very same beginning of every line and "
    texts = sorted({lead + "".join(random.choices("abcdefghij", k=9)) for _ in range(300)} | {lead + "aaaaaaaa" + c for c in "bcdefg"})
    docs = docs_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    found = {frozenset(p) for p in ((r["a"], r["b"]) for r in lines.candidate_pairs(spark, docs.select(F.lit(0).alias("k"), "text"), group_rows=16).collect())}
    whole = {frozenset(p) for p in ((r["a"], r["b"]) for r in lines.candidate_pairs(spark, docs.select(F.lit(0).alias("k"), "text")).collect())}
    assert found == whole and whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=12), st.text("abc", max_size=12)), max_size=8), st.integers(1, 3))
def test_banded_distance(pairs, edits):
    found = lines.banded_distances(pairs, edits).tolist()
    for (a, b), d in zip(pairs, found):
        true = edit_distance(a, b)
        assert d == true if true <= edits else d > edits


def test_lines_of_odd_documents(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect() if r[0] != 6]
    assert found_lines(spark, odd.where("doc_id is null or doc_id <> 6")) == plain_result(rows)
    by_words = lines.dedup_lines(spark, odd.where("doc_id is null or doc_id <> 6"), words_an_edit=lines.WORDS_AN_EDIT)
    assert Counter(tuple(r) for r in by_words.select("row.doc_id", "n_lines", "n_removed", "n_links", "kept_text").collect()) == plain_result(rows, by_words=True)
    new = lines.without_repeated_lines(spark, odd)
    assert new.columns == odd.columns and new.dtypes == odd.dtypes and new.count() == odd.count()
    assert lines.dedup_lines(spark, empty).count() == 0


def near_by_either_rule(x, y):
    one, other = x.split(" "), y.split(" ")
    allowed = max(len(one), len(other)) // lines.WORDS_AN_EDIT
    by_words = allowed > 0 and abs(len(one) - len(other)) <= allowed and edit_distance(one, other) <= allowed
    by_chars = min(len(x), len(y)) >= lines.NEAR_CHARS and abs(len(x) - len(y)) <= lines.EDITS and edit_distance(x, y) <= lines.EDITS
    return by_words or by_chars


def word_edited(random, words, vocabulary, n):
    words = list(words)
    for _ in range(n):
        k = random.randrange(len(words))
        words[k : k + random.randrange(2)] = random.choices(vocabulary, k=random.randrange(2))
    return words


def test_lines_near_in_words_equal_all_pairs(spark, docs_of):
    rng = random.Random(5)
    # Few words, so that runs of them recur at many places.
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 11))) for _ in range(40)]
    bases = [rng.choices(vocabulary, k=n) for n in (9, 10, 11, 19, 20, 36, 40, 44, 60, 120)] + [["same"] * 50]
    texts = []
    for base in bases:
        for n in (0, 1, 2, len(base) // 10, len(base) // 10, len(base) // 10 + 1):
            texts.append(" ".join(word_edited(rng, base, vocabulary, n)))
    # Two edits of characters that are four of words, around the length from which these suffice.
    for n in (38, 39, 40, 41, 42):
        w = rng.choices(vocabulary, k=n)
        texts += [" ".join(w), " ".join(w[:5]) + " ".join(w[5:30]) + " ".join(w[30:])]
    rng.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    near = {i: [] for i in range(len(texts))}
    for i, x in enumerate(texts):
        for j in range(i):
            if near_by_either_rule(x, texts[j]):
                near[i].append(j)
                near[j].append(i)
    assert sum(map(len, near.values())) > 2 * len(texts)
    found = lines.dedup_lines(spark, docs_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)]).repartition(5), words_an_edit=lines.WORDS_AN_EDIT)
    got = {r[0]: (r[1], r[2]) for r in found.select("row.doc_id", "n_links", "n_removed").collect()}
    assert got == {i: (len(js), int(any(j < i for j in js))) for i, js in near.items()}


def test_near_lines_leave_no_row_for_each_pair(spark, docs_of):
    # Near copies of one line, and those of another that shares its beginning and end with it.
    words = [f"word{k}" for k in range(20)]
    texts = [" ".join(words[:10] + [x * n] + words[11:]) for n in range(1, 41) for x in "yz"]
    texts += [" ".join(words[:5] + ["other"] * 6 + [f"v{n}"] + words[12:]) for n in range(40)]
    source = docs_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)]).select(F.col("doc_id").alias("row_key"), "text", "doc_id")
    firsts = lines.occurrences(source).select("id", "row_key", "doc_id", "line_no")
    keyed = lines.keyed_lines(source.select("row_key", "text"), lines.EDITS, lines.NEAR_CHARS, lines.WORDS_AN_EDIT, 40)
    rows = lines._meeting_rows(spark, keyed, "w")
    assert lines._meet(spark, rows, lines.ByWords(lines.WORDS_AN_EDIT), lines.GROUP_ROWS).count() <= rows.count()
    expected = [sum(near_by_either_rule(x, y) for y in texts) - 1 for x in texts]
    for group_rows in (16, lines.GROUP_ROWS):
        found = lines.links(spark, source.select("row_key", "text"), firsts, words_an_edit=lines.WORDS_AN_EDIT, group_rows=group_rows)
        assert {r["row_key"]: (r["n_links"], r["late"]) for r in found.collect()} == {i: (n, i not in (0, 80)) for i, n in enumerate(expected)}


def test_line_with_one_word_changed_goes(spark, docs_of, monkeypatch):
    line = "the committee met on monday to read the long report about rivers and lakes"
    texts = [line, line.replace("monday", "wednesday"), line.replace("long ", ""), line + " again", "ten other words that stand in no other line here"]
    monkeypatch.setattr(queries, "_table", lambda *_: docs_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    assert sorted((r["doc_id"], r["n_removed"]) for r in queries.op6_line_dedup(spark, "").collect()) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 0)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_word_distance(a, b):
    assert lines.word_distance(a, b) == edit_distance(a, b)


@pytest.mark.parametrize("copies", [1, 40])
def test_near_in_words_one_by_one_and_together(copies):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(30)]
    pairs = []
    for n in (1, 9, 10, 11, 20, 33, 64, 319, 330):
        for _ in range(4):
            base = rng.choices(vocabulary, k=n)
            pairs.append((" ".join(base), " \t".join(word_edited(rng, base, vocabulary, rng.randrange(n // 10 + 3)) or ["w"])))
    expected = []
    for a, b in pairs:
        one, other = a.split(), b.split()
        allowed = max(len(one), len(other)) // lines.WORDS_AN_EDIT
        expected.append(allowed > 0 and edit_distance(one, other) <= allowed)
    assert 5 < sum(expected) < len(pairs)
    assert lines.near_in_words(pairs * copies, lines.WORDS_AN_EDIT).tolist() == expected * copies


def plain_candidates(rows, words_an_edit):
    """Pairs of rows (key, id, words, place or None, mark, own) that may be near, each tried."""
    found = set()
    for i, (key, a, words_a, at_a, mark_a, own_a) in enumerate(rows):
        for other, b, words_b, at_b, mark_b, own_b in rows[:i]:
            edits, longer = max(words_a, words_b) // words_an_edit, words_a - words_b
            moves = abs(longer) if at_a is None or at_b is None else abs(at_a - at_b) + abs(longer - (at_a - at_b))
            if key == other and a != b and (own_a or own_b) and moves <= edits and (mark_a ^ mark_b).bit_count() <= 2 * edits:
                found.add((min(a, b), max(a, b)))
    return found


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 2), st.integers(0, 9), st.integers(9, 45), st.one_of(st.none(), st.integers(0, 12)), st.integers(0, 31), st.booleans()),
        min_size=1,
        max_size=40,
    )
)
def test_ranges_of_rows_equal_all_pairs(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[2], lines.ANYWHERE if r[3] is None else r[3]))
    columns = {c: np.array([r[k] for r in rows]) for c, k in (("key", 0), ("id", 1), ("mark", 4), ("own", 5))}
    place = np.array([r[2] << 32 | (lines.ANYWHERE if r[3] is None else r[3]) for r in rows])
    columns |= {"place": place, "sub": np.zeros(len(rows), dtype=np.int32), "side": np.full(len(rows), -1, dtype=np.int32)}
    a, b = lines._pairs_of(columns, lines.ByWords(10))
    assert set(zip(a.tolist(), b.tolist())) == plain_candidates(rows, 10)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)


# --- decontamination


def plain_matches(text, items, similarity=decontaminate.SIMILARITY):
    low = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for item_id, item in items:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        if w:
            row = [0] * (len(low) + 1)
            for i, x in enumerate(w, 1):
                last, row[0] = row[0], i
                for j, y in enumerate(low, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            if min(row) <= decontaminate.edits_allowed(len(w), similarity):
                out.add(item_id)
    return out


def test_search_is_exact():
    random.seed(2)
    for _ in range(300):
        p = random.choices(range(4), k=random.randrange(1, 9))
        t = random.choices(range(4), k=random.randrange(0, 20))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert decontaminate.search(p, t)[0] == min(row)


def test_contamination_equals_plain_search(spark, docs_of):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "And"] * 20
    items = [(k, " ".join(random.choices(vocabulary, k=random.randrange(1, 60)))) for k in range(40)] + [(40, None), (41, "")]
    docs, planted = [], 0
    for i in range(250):
        text = random.choices(vocabulary, k=random.randrange(0, 120))
        if i % 2:
            item = random.choice(items[:40])[1].split()
            for _ in range(random.randrange(0, 1 + len(item) // 6)):
                k = random.randrange(len(item) + 1)
                item[k : k + random.randrange(2)] = random.choices(vocabulary, k=random.randrange(2))
            k = random.randrange(len(text) + 1)
            text[k:k] = [w.upper() for w in item]
        docs.append((i, random.choice([" ", "\n"]).join(text), "en", "s", 0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in decontaminate.contamination(docs_of(docs).repartition(3), benchmark).collect()}
    expected = {d[0]: plain_matches(d[1], items) for d in docs}
    assert all(found[k] <= expected[k] for k in expected)  # verified, so never too many
    pairs = [(k, x) for k in expected for x in expected[k]]
    assert sum(x in found[k] for k, x in pairs) >= decontaminate.RECALL * len(pairs)


def test_contamination_in_blocks_and_of_odd_documents(spark, odd, empty, table, monkeypatch):
    benchmark = spark.createDataFrame([(1, "word3 and word4 and word5 and word6 and word7 and"), (2, None), (None, "zzz")], "item_id long, text string")
    whole = Counter((r[0], tuple(m["item_id"] for m in r[2])) for r in decontaminate.contamination(odd, benchmark).collect())
    assert whole[(4, (1,))] == 1 and whole[(1, ())] == 1
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    blocks = Counter((r[0], tuple(m["item_id"] for m in r[2])) for r in decontaminate.contamination(odd, benchmark).collect())
    assert {k[0] for k in blocks if k[1]} == {k[0] for k in whole if k[1]}
    kept = decontaminate.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns
    assert {r[0] for r in odd.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()} == {4, 5}
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(odd, benchmark.limit(0)).where(F.size("matches") > 0).count() == 0


# --- packing


def plain_best_fit(pieces, capacity):
    """pieces in order: (length, source, cluster); bin of each."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= length and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fits:
            room = min(fits)[0]
            k = [k for r, k in fits if r == room]
        else:
            bins.append({"room": capacity, "s": set(), "c": set()})
            k = [len(bins) - 1]
        out.append(k)
        b = bins[k[0]]
        b["room"] -= length
        b["s"].add(source)
        b["c"].add(cluster)
    return len(bins), bins


def test_packing_is_best_fit():
    random.seed(8)
    bins = packing.Bins(5, 40, 4)
    plain = []
    for _ in range(600):
        length, source, cluster = random.randrange(0, 60), random.randrange(-1, 5), random.randrange(-1, 40)
        place = bins.tightest(length, source, cluster)
        rooms = [b["room"] for b in plain if b["room"] >= length and (source < 0 or source not in b["s"]) and (cluster < 0 or cluster not in b["c"])]
        assert (place < 0) == (not rooms)
        if rooms:
            assert bins.residual[place] == min(rooms)
        k = bins.put(place, 100, length, source, cluster)
        if k == len(plain):
            plain.append({"room": 100, "s": set(), "c": set()})
        plain[k]["room"] -= length
        plain[k]["s"].add(source)
        plain[k]["c"].add(cluster)
        assert sorted(b["room"] for b in plain) == bins.residual[: bins.n].tolist()


@pytest.mark.parametrize("group_pieces", [8192, 40])
@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing_keeps_the_rules(odd, table, which, group_pieces):
    docs = odd if which == "odd" else table("documents")
    length, cluster = packing.word_length(docs["text"]), packing.text_cluster(docs["text"])
    placed = packing.best_fit(docs, length, cluster, capacity=500, group_pieces=group_pieces).collect()
    expected = Counter()
    for doc, n in docs.select("doc_id", length).collect():
        for piece, start in enumerate(range(0, max(n, 1), 500)):
            expected[(doc, piece, start, min(500, n - start))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in placed) == expected
    bins = {}
    for r in placed:
        bins.setdefault((r["group"], r["bin"]), []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r["slot"])
        assert sum(r["length"] for r in rows) <= 500
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        for c in ("source", "cluster"):
            values = [r[c] for r in rows if r[c] is not None]
            assert len(values) == len(set(values))


def test_packing_nothing(empty):
    assert packing.best_fit(empty, packing.word_length(empty["text"]), packing.text_cluster(empty["text"])).count() == 0


# --- pipeline


def test_pipeline_equals_its_stages_done_plainly(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, table, SF_DIR)
    assert clean.columns == table.columns
    model = toxicity.fit(spark, table, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, model).collect()}
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert left == {k: r["text"] for k, r in docs.items() if scores[k] < 0.5}
    texts = {r[0]: r[4] for r in plain_result(list(left.items()), by_words=True)}
    by_line = stages["line_dedup"](spark, clean, SF_DIR)
    assert by_line.dtypes == table.dtypes
    assert {r["doc_id"]: r["text"] for r in by_line.collect()} == texts
    from test_text_operators import plain_components, plain_fingerprint

    groups = plain_components([(k, plain_fingerprint(t)) for k, t in texts.items()])
    single = stages["simhash_near_dedup"](spark, by_line, SF_DIR)
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert kept == {k: texts[k] for k, _, c in groups if k == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rest = {r["doc_id"] for r in stages["benchmark_decontamination"](spark, single, SF_DIR).collect()}
    assert rest == {k for k, t in kept.items() if not plain_matches(t, items)}
    result = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in result.collect()} == rest


def test_every_stage_takes_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            docs.collect()


def test_a_key_of_lines_is_sent_once_in_few_bytes():
    # Keys of lines crossed the network with their rows written beside them, 22 bytes and more for each.
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(400)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    found = lines.Lines(data, np.cumsum([0, *map(len, texts)]))
    marks, words = found.word_parity()
    line, key, place, own = lines._one_a_line(*lines.word_keys(found, np.arange(len(texts)), lines.WORDS_AN_EDIT))
    part = lines._Part(0, 2)
    part.add((found.id, found.parity(), marks, words), w=(line, key, place & 0xFFFFFFFF, own), c=(line[:0], key[:0], place[:0], own[:0]))
    sent = sum(b.nbytes for b in part.rows())
    assert sent < 10 * len(key) + 64 * len(texts)


@pytest.mark.parametrize("n", [9, 10, 14, 19, 20, 29, 39, 40, 59, 80, 95, 130])
def test_runs_of_longer_lines_are_looked_up_by_all_lines_in_reach(n):
    rng = np.random.default_rng(n)
    for m in range(max(n, lines.WORDS_AN_EDIT), n + 15):
        edits = m // lines.WORDS_AN_EDIT
        if m - n > edits:
            break
        for _ in range(20):
            longer = [f"w{k}" for k in rng.integers(0, 40, m)]
            gone = set(rng.choice(m, m - n, replace=False).tolist())
            other = [w for k, w in enumerate(longer) if k not in gone]
            for k in rng.choice(n, edits - (m - n), replace=False).tolist():
                other[k] = "changed"
            texts = [" ".join(longer), " ".join(other)]
            found = lines.Lines(np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))
            line, key, _, own = lines.word_keys(found, np.arange(2), lines.WORDS_AN_EDIT)
            assert set(key[(line == 0) & own].tolist()) & set(key[line == 1].tolist())


def test_lines_end_where_their_words_do():
    for texts in (["  a b \t\n \n\n c", "", " " * 100, " " * 90 + "d" + " " * 70 + "\n\te"], ["\u00a0 \u00e4 \n", "\n\u4e2d \n " + " " * 50]):
        raw = [t.encode() for t in texts]
        found = lines.Lines(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        got = [(t, n, "".join(map(chr, found.codes[a:b].tolist()))) for t, n, a, b in zip(found.text.tolist(), found.number.tolist(), found.start.tolist(), found.end.tolist())]
        assert got == [(t, n, line.strip(" \t")) for t, text in enumerate(texts) for n, line in enumerate(text.split("\n")) if line.strip(" \t")]


def test_workers_give_back_what_they_freed():
    def resident() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1])

    kept = []
    before = resident()
    for _ in range(400):  # small pieces that stay keep the large ones' memory from going
        large = [np.ones(1 << 13) for _ in range(20)]
        kept.append(np.ones(64))
        del large
    pieces = [np.ones(1 << 13) for _ in range(1600)]
    kept += pieces[::400]
    del pieces
    give_back()
    assert resident() - before < 30_000
