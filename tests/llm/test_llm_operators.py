import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import components, contamination, sha, shingle_set, substrings, windows
from data import documents, frame, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrill.llm import bpe, chat, decontaminate, jaccard, language, neighbours, reshard, substring_index, suffixes, tables, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(params=[1, 2])
def docs(request):
    return documents(request.param)


# 1


def test_flow_moves_least():
    flow = reshard.min_cost_flow([10, 0, 5], [5, 5, 5], [[int(i != j) for j in range(3)] for i in range(3)])
    assert [sum(f) for f in flow] == [10, 0, 5] and [sum(f) for f in zip(*flow)] == [5, 5, 5]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 5


@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_flow_is_least(supply, n):
    total = sum(supply)
    capacity = [total * (j + 1) // n - total * j // n for j in range(n)]
    flow = reshard.min_cost_flow(supply, capacity, [[int(i != j) for j in range(n)] for i in range(len(supply))])
    assert [sum(f) for f in flow] == supply and [sum(f) for f in zip(*flow)] == capacity
    moved = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
    assert moved == total - sum(min(s, c) for s, c in zip(supply, capacity))


@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=60), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_blocks_move_little_more_than_the_flow(blocks, n_new):
    """Each shard's last block to a new shard may not fit its flow: what moves beyond the least is under a block for each pair of shards."""
    sizes = {(i, b): size for i, own in enumerate(blocks) for b, size in enumerate(own)}
    to = reshard.block_transfers(sizes, len(blocks), n_new)
    total, largest = sum(sizes.values()), max(sizes.values())
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    least = total - sum(min(sum(own), c) for own, c in zip(blocks, capacity))
    moved = sum(size for key, size in sizes.items() if to[key] != key[0])
    assert moved <= least + len(blocks) * n_new * largest
    got = [sum(size for key, size in sizes.items() if to[key] == j) for j in range(n_new)]
    assert max(abs(g - c) for g, c in zip(got, capacity)) <= largest + 1


def placed(spark, docs, n_new=8):
    old = F.pmod(F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")), F.lit(6))
    rows = reshard.reshard(frame(spark, docs), old, 6, n_new).rows
    return rows.select("row.doc_id", "size", "text_crc32", "shard", "slot").collect()


def test_resharding(spark):
    import zlib

    docs = [(i, t) for i, t in enumerate([*texts(3, 900), "long " * 4_000])]
    rows = placed(spark, docs)
    by = dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(by)
    assert all(r.size == len((by[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in rows)
    shards = {s: [r for r in rows if r.shard == s] for s in range(8)}
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    size = [sum(r.size for r in own) for own in shards.values()]
    assert max(size) - min(size) < 0.1 * sum(size) / 8
    where = {}
    for r in rows:
        where.setdefault(by[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_ties_of_equal_sizes(spark):
    rows = placed(spark, [(i // 2, f"{i // 4:06}") for i in range(4000)])
    size = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(size) - min(size) < 0.05 * sum(size) / 8


def test_resharding_a_hot_text(spark):
    docs = [(i if i % 5 else None, "the same text over and over" if i % 3 else f"text {i} " * 4) for i in range(3000)]
    docs = [(i, t) for i, t in docs if i is not None or t.startswith("text")]
    size = {}
    for r in placed(spark, docs):
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert len(size) == 8 and max(size.values()) < 1.05 * min(size.values())


def test_texts_over_half_a_shard_stay_whole(spark):
    docs = [(i, f"large text {i % 10} " if i % 10 < 6 else f"text {i:07} x ") for i in range(4000)]
    where, size = {}, {}
    for r in placed(spark, docs):
        where.setdefault(dict(docs)[r.doc_id], set()).add(r.shard)
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in where.values())
    assert len(size) == 8 and max(size.values()) < 1.05 * min(size.values())


def test_resharding_edges(spark):
    assert placed(spark, []) == []
    assert len(placed(spark, [(None, None), (1, "a"), (1, "a")])) == 3


def test_rewriting(spark, tmp_path):
    """An old layout of 4 shards, made 7, then 2, in its own folder: rows stay whole, nulls and repeated ids included, and emptied shards go."""
    from collections import Counter

    docs = [*((i, f"text {i}", i * 0.5) for i in range(200)), (None, "a", 1.0), (None, None, 2.0), (7, "again", 3.0), (7, "again", 3.0), (8, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, slot double")
    path, schema = str(tmp_path / "shards"), df.schema
    old = lambda n: F.pmod(F.xxhash64("text"), F.lit(n))
    for k, n_new in ((4, 7), (7, 2), (2, 2)):
        now = df if k == 4 else reshard.shards(spark, path, schema)
        plan = reshard.reshard(now, old(4) if k == 4 else F.col("shard"), k, n_new)
        affected = reshard.rewrite(plan, path)
        if k == 4:
            reshard.rewrite(reshard.Plan(plan.rows, list(range(7)), 0), path)  # shards that didn't change had no files yet
        back = reshard.shards(spark, path, schema).collect()
        assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t) for i, t, _ in docs)
        sizes = Counter()
        for r in back:
            sizes[r.shard] += len((r.text or "").encode()) + 1
        assert set(sizes) == set(range(n_new)) and max(sizes.values()) < 1.2 * min(sizes.values())
        assert all(sorted(r.slot for r in back if r.shard == s) == list(range(sum(r.shard == s for r in back))) for s in sizes)
        assert affected == [] if k == n_new else 2 in affected
    assert not (tmp_path / "shards" / "shard=2").exists()


# 2


def toxic_corpus(n=400, seed=3):
    import random

    r = random.Random(seed)
    clean = ["".join(r.choice("abdeghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    roots = ["blorgheit", "quazzik", "fnarpel"]
    ends = ["", "s", "ed", "ing", "er", "o", "ix", "um", "ant", "ol"]
    out = []
    for i in range(n):
        w = [r.choice(clean) for _ in range(r.choice([5, 40, 300]))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(1, len(w) // 60)):
                w.insert(r.randrange(len(w) + 1), r.choice(roots) + r.choice(ends[: 5 if i % 2 else 10]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark):
    rows = toxic_corpus(1600)
    docs, labels = frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y, None) for i, _, y in rows if i % 4], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 4 == 0]
    assert sum(held) / len(held) > 0.93
    assert all(0 <= s <= 1 for s in got.values())
    kept = toxicity.below(docs, model, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_toxicity_edges(spark):
    model = toxicity.train(["good words here", "bad bad"], [0, 1], rounds=5)
    docs = [*documents(), (None, None), (7, "x " * 50_000), (8, "y" * 100_000)]
    assert toxicity.score(frame(spark, docs), model).count() == len(docs)
    assert toxicity.score(frame(spark, []), model).count() == 0
    for texts_, labels in (([], []), (["a"], [1]), (["", ""], [0, 1])):
        assert toxicity.train(texts_, labels, rounds=2).logits(pa.array(["", "a", None])).shape == (3,)


def test_label_ties_do_not_depend_on_order():
    rows = [("a quazzik b", 0), ("a quazzik b", 1), *((f"word{i} clean text", 0) for i in range(8)), *((f"quazzik {i}", 1) for i in range(4))]
    models = [toxicity.train(*map(list, zip(*own)), rounds=8, least_texts=2) for own in (rows, rows[::-1])]
    assert (models[0].value == models[1].value).all() and models[0].bias == models[1].bias


def test_toxicity_by_hand():
    """The score of a text from its words' n-gram vectors, one word at a time."""
    rows = toxic_corpus(300)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], rounds=10)

    def word(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return model.value[toxicity.word_grams(raw, np.array([0]), np.array([len(raw)]), len(model.value))[0]].mean()

    for _, t, _ in rows[:40]:
        words = t.split()
        parts = -(-len(words) // toxicity.SEGMENT)
        own = [[w for k, w in enumerate(words) if k * parts // len(words) == p] for p in range(parts)]
        logit = np.array([np.mean([word(w) for w in ws]) + model.bias for ws in own])
        weight = np.exp(toxicity.POOL * (logit - logit.max()))
        assert model.logits(pa.array([t]))[0] == pytest.approx((weight * logit).sum() / weight.sum(), abs=1e-9)


# 3


def vectors(seed=1):
    r = np.random.default_rng(seed)
    base = r.normal(size=(400, 16))
    close = [base[i % 7] + 0.08 * r.normal(size=16) for i in range(150)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *close, base[3], base[3]])]
    return rows + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None]), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (1, rows[1][1])]


def brute_links(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0:
            good[i] = np.array(v) / np.linalg.norm(v)
    link = lambda a, b: a in good and b in good and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold
    ids = sorted({i for i, _ in rows})
    return {i: sum(link(i, j) for j in ids if j != i) for i in ids}, components(ids, link)


def test_near_duplicates(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    as_floats = [(r.vec_id, r.embedding) for r in df.collect()]
    links, comp = brute_links(as_floats)
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, audited=F.lit(True)).collect()}
    assert set(got) == set(links)
    assert sum(min(got[i].n_links, n) for i, n in links.items()) >= 0.98 * sum(links.values())
    assert all(got[i].n_links <= n for i, n in links.items())
    assert sum(got[i].component_id == c for i, c in comp.items()) >= 0.98 * len(comp)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.near_duplicates(df).collect() == []
    assert [r.n_links for r in neighbours.near_duplicates(spark.createDataFrame([(1, None)], df.schema)).collect()] == [0]


@pytest.mark.parametrize("copies", [False, True])
def test_near_duplicates_beside_a_large_group(spark, copies):
    r = np.random.default_rng(5)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    one, off = unit(r.normal(size=(900, 64))), r.normal(size=(900, 64))
    off = unit(off - (off * one).sum(1, keepdims=True) * one)
    group = np.repeat(unit(one[:1] + 0.02 * r.normal(size=(4, 64))), 400, axis=0) if copies else unit(one[:1] + 0.02 * r.normal(size=(600, 64)))
    pairs = np.stack([one, 0.905 * one + np.sqrt(1 - 0.905**2) * off], 1)[1:].reshape(-1, 64)
    rows = [(i, v.tolist()) for i, v in enumerate([*pairs, *group])]
    got = {x.vec_id: x for x in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=1, audited=F.lit(True)).collect()}
    assert all(got[i].n_links == len(group) - 1 for i in range(len(pairs), len(rows)))
    assert sum(got[i].n_links == 1 for i in range(len(pairs))) >= 0.97 * len(pairs)


def test_vectors_that_share_an_id(spark):
    """Different vectors of one vec_id, null ids, repeated rows and clashing columns."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (4, [-1.0, 0.0]), (5, None), (5, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0, b"", 1.0) for r in rows], "vec_id long, embedding array<double>, node long, n int, vec binary, sim double")
    report = {}
    got = neighbours.near_duplicates(df, audited=F.lit(True), report=report).collect()
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert report and all(x == 1 for x in report.values())


def test_recall_is_measured_where_no_audited_vector_links(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 16))
    rows = [(i * 20, v.tolist()) for i, v in enumerate(base)] + [(7, [1.0] * 16), (9, [1.0] * 15 + [1.01])]
    report = {}
    got = {x.vec_id: x.n_links for x in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), report=report).collect()}
    assert got[7] == got[9] == 1 and report


@pytest.mark.parametrize("size", [3, 1000])
def test_audit_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "ASKED", size)
    r = np.random.default_rng(2)
    m = r.normal(size=(40, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, v.tobytes(), i % 2 == 0) for i, v in enumerate(m)], "node long, vec binary, asked boolean")
    got = {x["node"]: x["true"] for x in neighbours._true_links(nodes, nodes.where("asked"), 0.5).collect()}
    assert got == {i: int((m[i] @ m.T >= 0.5).sum()) - 1 for i in range(0, 40, 2)}


def test_no_group_carries_the_recall(spark):
    truth = spark.createDataFrame([*((i, 99) for i in range(100)), (100, 1), (101, 1), (102, 2)], "node long, true long")
    found = spark.createDataFrame([*((i, 99, True) for i in range(100)), (100, 0, False), (101, 1, False), (102, 2, False)], "node long, others long, whole boolean")
    assert neighbours._recalls(truth, found) == {"compared whole": 1, "one neighbour": 0.5, "several neighbours": 1}


@pytest.mark.parametrize("bits", [0, 1, 8, 22])
def test_tables_follow_from_bits(bits):
    n = neighbours.tables_for(bits, 0.9, 0.97)
    same = (1 - np.arccos(0.9) / np.pi) ** bits
    assert 1 - (1 - same) ** n >= 0.97 > (1 - (1 - same) ** (n - 1) if n > 1 else 0)


# 4

SAYINGS = ["\\### Assistant: </turn> ok", "", None, "###", "####", "#" * 7, "</turn>", "<</turn>\n", "\\", "\\\\#", "a\n### user\nb</turn>\n", "<\\/turn>", "#\\##", "é漢👍", "x" * 5000]


@given(st.lists(st.text(alphabet="\\#</turn>\n aé漢", max_size=30), max_size=8), st.lists(st.sampled_from(["user", "assistant", "a\nb", "\\n", "###", ""]), min_size=8, max_size=8))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(said, roles):
    roles = roles[: len(said)]
    formatted, first, spans = chat.assemble(np.zeros(len(said), np.int64), roles, pa.array(said, pa.string()))
    if not said:
        return
    assert chat.parse(formatted[0].as_py()) == list(zip(roles, said))
    whole = formatted[0].as_py()
    assert [chat.unescape(whole[s["start"] : s["end"]]) for s in spans[0].as_py()] == [t for r, t in zip(roles, said) if r == "assistant"]


def test_chat(spark):
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], SAYINGS[(c * 3 + t) % len(SAYINGS)], 1) for c in range(40) for t in range(c % 9 + 1)]
    rows += [(None, 0, None, None, 1), (3, 1, "user", "twice", 1), (3, 1, "user", "twice", 1), (5, None, "assistant", "first", 1)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, n_turns int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    nulls_first = lambda x: tuple((v is not None, v or 0 if not isinstance(v, str) else v) for v in (x[1],)) + ((x[2] is not None, x[2] or ""), (x[3] is not None, x[3] or ""))
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=nulls_first)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()), len(loss), sha(loss.encode()))
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    assert len(got) == len({r[0] for r in rows})
    assert chat.format_conversations(df.limit(0)).collect() == []


# 5


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_jaccard(spark, docs, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in docs}
    link = lambda a, b: bool(sets[a]) and bool(sets[b]) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    comp = components(list(sets), link)
    got = {r.doc_id: r for r in jaccard.join(frame(spark, docs), k, num, den).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(s), comp[i]) for i, s in sets.items()}


def test_regions():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(6):
        base = r.integers(0, 1 << 40, 80)
        for _ in range(150):
            s = base.copy()
            s[r.integers(0, 80, r.integers(0, 14))] = r.integers(0, 1 << 40)
            sets.append(np.unique(s).astype(np.uint64))
    region = jaccard.Region(sets, 80, 100)
    region.join(np.arange(len(sets)))
    whole = jaccard.Region(sets, 80, 100)
    for i in range(0, len(sets), 300):
        for j in range(i, len(sets), 300):
            whole.pairs(np.arange(i, i + 300)) if i == j else whole.pairs(np.arange(i, i + 300), np.arange(j, j + 300))
    same = lambda x: [x.forest.find(i) for i in range(len(sets))]
    assert same(region) == same(whole)


@pytest.mark.parametrize("n", [5, 6, 11, 40])
def test_large_regions_are_split(monkeypatch, n):
    monkeypatch.setattr(jaccard, "MOST_MEMBERS", 5)
    rows, region = jaccard.split(np.arange(n), np.full(n, 7, np.uint64))
    by = {}
    for i, p in zip(rows.tolist(), region.tolist()):
        by.setdefault(p, set()).add(i)
    assert all(any({i, j} <= own for own in by.values()) for i in range(n) for j in range(i))
    assert max(map(len, by.values())) <= 6


def test_jaccard_edges(spark):
    assert jaccard.join(frame(spark, [])).collect() == []
    got = jaccard.join(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, "other words in this text here"), (4, "something else entirely is here now"), (5, "a b c d e f"), (5, ""), (6, None)])).collect()
    # null with the first text sorts before 4, whose other text is of the same node, as is the empty text of 5
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id != 6) == sorted([(0, 2, None), (4, 2, None), (0, 2, None), (4, 2, None), (5, 2, None), (5, 0, None)], key=lambda x: x[:2])
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id == 6] == [(0, 6)]


def test_jaccard_probe_of_repeated_ids(spark):
    x = " ".join(f"x{i}" for i in range(40))
    y = " ".join(f"y{i}" for i in range(40))
    rows = [(23, x), (23, y), (5, x), (6, x + " more"), (390, y + " more")]
    got = jaccard.join(frame(spark, rows), 3, 90, 100).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 5) for i in (5, 6, 23, 390)} and len(got) == 5


def test_jaccard_with_repeated_ids(spark):
    """Ids drawn anew for the same texts: links of a node are those of all its rows."""
    r = np.random.default_rng(8)
    for seed in (1, 2):
        docs = [(int(r.integers(0, 60)), t) for _, t in documents(seed)]
        sets = [(i, shingle_set(t, 3)) for i, t in docs]
        ids = sorted({i for i, _ in docs})
        pairs = {(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= 90 * len(s | t)}
        comp = components(ids, lambda a, b: (a, b) in pairs)
        got = jaccard.join(frame(spark, docs), 3, 90, 100).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((i, len(s), comp[i]) for i, s in sets)


def test_cells_keep_links(monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_MEMBERS", 20)
    r = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        base = r.integers(0, 1 << 40, 100)
        for _ in range(25):
            s = base.copy()
            s[: r.integers(0, 12)] = r.integers(0, 1 << 40)
            sets.append(np.unique(s).astype(np.uint64))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    h, size = jaccard.profiles(np.concatenate(sets), at), np.diff(at)
    parts = list(jaccard.cells(np.arange(len(sets)), h, size, 90, 100))
    assert len(parts) > 5 and any(small for _, small in parts)
    of = [set(p.tolist()) for p, _ in parts]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (size[i] + size[j] - both):
                assert any({i, j} <= p for p in of)


# 6


@pytest.mark.parametrize("batches", [1, 3])
def test_repeated_windows(spark, docs, batches):
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring_index.remove_repeats(frame(spark, docs), 12, batches).collect()}
    assert got == windows(docs, 12)


def test_index_is_incremental(spark):
    """What a late batch finds is what repeats between it and the compacted history, and nothing else."""
    docs = documents(4)
    index = substring_index.FingerprintIndex(spark, 12, most_runs=2)
    for part in (docs[:20], docs[20:30], docs[30:50]):
        index.add(frame(spark, part))
    assert len(index.runs) == 3
    index.add(frame(spark, docs[50:]))
    assert len(index.runs) == 2  # the first three were compacted
    late = [(999, max((t or "" for _, t in docs), key=len)), (998, "words that are nowhere else " * 2)]
    found = index.add(frame(spark, late))
    out = tables.attach(tables.keyed(frame(spark, [*docs, *late])), found, index.n, lambda: (substring_index.keep_words, None), substring_index.KEPT)
    words = {i: (t or "").split() for i, t in [*docs, *late]}
    new = {tuple(words[i][p : p + 12]) for i, _ in late for p in range(len(words[i]) - 11)}
    whole = windows([*docs, *late], 12)
    for r in out.collect():
        if r.id in (998, 999):
            assert (r.kept, r.n_removed) == (whole[r.id][0], whole[r.id][2])
        elif r.n_removed:
            assert any(tuple(words[r.id][p : p + 12]) in new for p in range(len(words[r.id]) - 11))
    assert {r.id for r in out.collect() if r.n_removed} >= {999}


def test_batches_do_not_multiply_packed_rows(spark, monkeypatch):
    """Steps that make a row from each task for each bucket are taken by all batches together, and find the same."""
    docs, made, old = documents(3, 200), {}, spark.conf.get("spark.sql.shuffle.partitions")
    rows = []

    def counted(df):
        out = tables.written(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(substring_index, "written", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        for batches in (1, 4):
            rows.clear()
            out = substring_index.remove_repeats(frame(spark, docs), 12, batches)
            made[batches] = sum(rows)
            assert {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in out.collect()} == windows(docs, 12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert made[1] > 144  # a row from each of 12 tasks for each of 12 buckets
    assert made[4] < 2 * made[1], made


def test_found_tells_of_all_batches_put(spark):
    docs = documents(4)
    kept = []
    for at_once in (True, False):
        index, found = substring_index.FingerprintIndex(spark, 12, most_runs=1), None
        for part in (docs[:25], docs[25:50], docs[50:]):
            if at_once:
                index.put(frame(spark, part))
            else:
                own = index.add(frame(spark, part))
                found = own if found is None else found.unionByName(own)
        out = tables.attach(tables.keyed(frame(spark, docs)), index.found() if at_once else found, index.n, lambda: (substring_index.keep_words, None), substring_index.KEPT)
        kept.append({r.id: (r.kept, r.n_words, r.n_removed) for r in out.collect()})
        with pytest.raises(ValueError, match="no batch"):
            index.found()
    assert kept[0] == kept[1] == windows(docs, 12)


def test_runs_are_merged():
    r = np.random.default_rng(3)
    kinds = {"fp": np.uint64, "sw": np.uint64, "sx": np.uint64, "id": np.int64, "tag": np.uint16, "pos": np.int64}
    runs = []
    for _ in range(4):
        x = {k: r.integers(0, 4, 300).astype(t) for k, t in kinds.items()}
        order = np.lexsort(tuple(x[k] for k in reversed(kinds)))
        runs.append({k: v[order] for k, v in x.items()})
    x = substring_index.merged(runs)
    assert list(zip(*(x[k].tolist() for k in kinds))) == sorted({row for run in runs for row in zip(*(run[k].tolist() for k in kinds))})


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_only_documents_that_met_are_read(spark, monkeypatch, most):
    monkeypatch.setattr(tables, "MOST_IDS", most)
    docs = documents(2)
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring_index.remove_repeats(frame(spark, docs), 12, 2).collect()}
    assert got == windows(docs, 12)
    assert {r.doc_id: len(r.kept) for r in suffixes.dedup_substrings(frame(spark, docs), 64).collect()} == {i: len(k) for i, (k, _, _) in substrings(docs, 64).items()}


def test_very_long_texts(spark):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in r.integers(0, 400, 60_000)]
    long = " ".join(words)
    docs = [(1, long), (2, "short and sweet"), (3, " ".join(words[20_000:20_100]) + " and more of it"), (4, "y" * 400_000)]
    got = {x.doc_id: (x.kept, x.n_words, x.n_removed) for x in substring_index.remove_repeats(frame(spark, docs), 35).collect()}
    assert got == windows(docs, 35)
    got = {x.doc_id: (len(x.kept), len(x.spans)) for x in suffixes.dedup_substrings(frame(spark, docs[:3]), 100).collect()}
    assert got == {i: (len(k), n) for i, (k, _, n) in substrings(docs[:3], 100).items()}
    sets = {i: len(shingle_set(t, 3)) for i, t in docs}
    assert {x.doc_id: x.n_shingles for x in jaccard.join(frame(spark, docs), 3, 90, 100).collect()} == sets
    slow = bpe.Library(PATH)
    for x in bpe.encode_documents(frame(spark, [*docs, (5, "z" * 300_000)]), PATH).collect():
        text = {**dict(docs), 5: "z" * 300_000}[x.doc_id]
        assert bytes(x.ids) == slow.encode([text])[0].astype("<u4").tobytes() and x.decoded == text


def test_repeated_rows_are_one_document(spark):
    text = " ".join(map(str, range(60)))
    got = substring_index.remove_repeats(frame(spark, [(1, text), (1, text), (2, "y"), (None, None)]), 12).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 0]
    assert substring_index.remove_repeats(frame(spark, []), 12).collect() == []


# 7


def test_language(spark):
    import random

    r = random.Random(2)
    words = {"en": "the and of with that from this which have been".split(), "de": "der und die mit das von nicht ist auch eine".split(), "fr": "les des une dans pour avec est que sur pas".split(), "es": "los las una para con del que por más está".split(), "xx": "zzu qqa wwi kko".split()}
    rows = [(i, " ".join(r.choice(w) for _ in range(r.randint(4, 60))), lang) for i, (lang, w) in enumerate(list(words.items()) * 60)]
    df = spark.createDataFrame([(t, lang, i, 5) for i, t, lang in rows], "text string, lang string, doc_id long, score int")
    model = language.learn(df.where("doc_id % 25 < 15"))
    got = {x.doc_id: x for x in language.identify(df, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "漢字"), (None, "the"), (5, "the and " * 30_000)], "doc_id long, text string")
    out = {x.doc_id: x for x in language.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred in words and out[5].lang_pred == "en" and len(out) == 6
    assert all(0 <= x.score <= 1 for x in out.values())
    none = language.learn(df.where("lang is null"))
    assert {x.lang_pred for x in language.identify(odd, none).collect()} == {"und"}
    one = language.learn(df.where("lang = 'fr'"))
    assert {x.lang_pred for x in language.identify(df.limit(3), one).collect()} == {"fr"}


def test_predictions_do_not_depend_on_the_batch():
    r = np.random.default_rng(4)
    words = {"en": "the and of with that".split(), "de": "der und die mit das".split(), "fr": "les des une dans pour".split(), "it": "che non per una sono".split()}
    some = lambda lang, k: " ".join(r.choice(words[lang], k))
    rows = [(some(lang, r.integers(5, 30)), lang) for lang in [*words] * 30]
    model = language.fit(*map(list, zip(*rows)), dims=512)
    odd = [some(lang, k) for lang in words for k in range(1, 12)] + ["", None, "a", "é", "1 2", "x" * 3000]
    alone = [language.predict(model, pa.array([t], pa.string())) for t in odd]
    for order in (np.arange(len(odd)), r.permutation(len(odd))):
        lang, score = language.predict(model, pa.array([odd[i] for i in order], pa.string()))
        assert [(x, y) for x, y in zip(lang, score)] == [(alone[i][0][0], alone[i][1][0]) for i in order]


def test_decisions_by_hand():
    """The decision of a text is the mean weight of its n-grams, family first, then votes of pairs."""
    model = language.fit(["the and of"] * 5 + ["der und die"] * 5 + ["les des une"] * 5 + ["che non per"] * 5, ["en"] * 5 + ["de"] * 5 + ["fr"] * 5 + ["it"] * 5, dims=256)
    for t in ("the", "und die", "une Les!", "non per che"):
        f = language.frequencies([t], 256)[0].astype(float)
        value = f @ model.weights + model.bias
        at = {c: i for i, c in enumerate(model.columns)}
        best = max(model.langs, key=lambda x: value[at["family", x]])
        i, j = model.langs[best]
        want = i if value[at["pair", i, j]] >= 0 else j
        assert language.predict(model, pa.array([t]))[0][0] == want


def test_rare_languages_are_sampled(spark):
    rows = [(i, f"common words {i}", "en") for i in range(3000)] + [(9000 + i, f"rara avis {i}", "la") for i in range(5)]
    texts_, langs = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    assert langs.count("la") == 5 and langs.count("en") == 100
    assert (texts_, langs) == language.sample(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string"), 200)


# 8


def test_engines_agree():
    fast, slow = bpe.tokenizer(PATH), bpe.Library(PATH)
    assert isinstance(fast, bpe.Ranked)
    lot = [f"{chr(c)}a{chr(c)}{chr(c)} {chr(c)}1{chr(c)}'s  {chr(c)} b" for c in [*range(1, 0x3400), *range(0xA000, 0xD800, 7), *range(0xE000, 0x11000, 3), *range(0x1D000, 0x1FC00, 5)]]
    assert all((a == b).all() for a, b in zip(fast.encode(lot), slow.encode(lot), strict=True))
    assert (fast.size == slow.size).all()


@given(st.lists(st.sampled_from([*"ab \n'stl1é漢!", "<|endoftext|>", "  ", "\u3000", "\u2003", "\u00a0", "👍🏽", "hello", " world"]), max_size=120).map("".join), st.lists(st.integers(1, 200), max_size=6))
@settings(max_examples=300, deadline=None)
def test_joins_are_repaired(text, at):
    t = bpe.tokenizer(PATH)
    cuts = sorted({min(a, len(text)) for a in at} - {0, len(text)})
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    starts = np.cumsum([0, *(len(p.encode()) for p in parts[:-1])]).tolist()
    raw = np.frombuffer(text.encode(), np.uint8)
    if not text:
        return
    got = bpe.join_chunks(raw, starts, t.encode(parts), t.size, t.encode)
    assert got is not None and got.tolist() == t.encode([text])[0].tolist()


def test_encoding(spark, docs):
    slow = bpe.Library(PATH)
    many = docs + [(1000 + i, (docs[3][1] or "a b ") * 40 + str(i)) for i in range(10)]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, many), PATH, mean_chunk=64).collect()}
    for i, text in many:
        ids = slow.encode([text or ""])[0]
        assert bytes(got[i].ids) == ids.astype("<u4").tobytes() and got[i].n_tokens == len(ids) and got[i].decoded == slow.decode([ids])[0]


def test_encoding_edges(spark):
    assert bpe.encode_documents(frame(spark, []), PATH).collect() == []
    rows = bpe.encode_documents(frame(spark, [(None, "a b"), (None, None), (1, "x"), (1, "x"), (1, "y z")]), PATH, decode=False).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 1, 1, 2, 2]
    word = public_tokenizers.path("word_bpe_49k.json")
    assert isinstance(bpe.tokenizer(word), bpe.Library)


# 9


@pytest.mark.parametrize("most_bytes", [1 << 20, 3000])
def test_contamination(spark, docs, most_bytes):
    docs = [*docs, (500, " ".join([docs[8][1] or "q"] * 300))]
    items = [("1", docs[5][1]), ("2", "One two"), ("3", None), ("4", ""), (None, "x y"), ("item five", " ".join((docs[8][1] or "q").split(" ")[:14])), ("item five", "ab" * 300), ("6", "A" * 700)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, n_words int")
    assert (decontaminate.parts(bench, 6, most_bytes)[0] > 1) == (most_bytes == 3000)
    df = frame(spark, [*docs, (None, "One two")])
    rows = [r for r in decontaminate.find(df, bench, 6, most_bytes).collect() if r.doc_id is not None]
    want = contamination(docs, items, 6)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want and len(rows) == len(docs)
    clean = decontaminate.clean(df, bench, 6, most_bytes)
    assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[1]} and clean.columns == df.columns
    by = dict(docs)
    for r in rows:
        for s in r.spans:
            found = by[r.doc_id][s.start : s.end]
            assert found and found == found.strip()
        assert sum(len(decontaminate.normalised(by[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find(frame(spark, []), bench, 2).collect() == []
    assert decontaminate.find(frame(spark, []), bench, 2, most_bytes=1).collect() == []
    some = frame(spark, [(1, "a b"), (1, "a b"), (1, "b c d"), (None, None)])
    for most in (1, 1 << 20):
        assert sorted((r.n_words, r.n_hit) for r in decontaminate.find(some, bench, 2, most).collect()) == [(0, 0), (2, 2), (2, 2), (3, 2)]
    assert decontaminate.find(some, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean(some, bench.limit(0)).count() == 4


# 10


def test_substrings(spark, docs):
    got = {r.doc_id: (bytes(r.kept), r.n_bytes - len(r.kept), len(r.spans)) for r in suffixes.dedup_substrings(frame(spark, docs), 64).collect()}
    assert got == substrings(docs, 64)


def test_substring_edges(spark):
    assert suffixes.dedup_substrings(frame(spark, [])).collect() == []
    text = "0123456789 abcdefghij " * 3 + "".join(map(chr, range(200, 400)))
    rows = [(1, text), (1, text), (None, text), (2, text), (2, "other"), (None, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, len(r.kept)) for r in suffixes.dedup_substrings(frame(spark, rows), 64).collect())
    kept, _, _ = substrings([(0, text)], 64)[0]
    assert got[:2] == [(-1, 0), (-1, len(kept))]
    assert [n for i, n in got if i == 1] == [0, 0] and [n for i, n in got if i == 2] == [0, 5]


@given(st.lists(st.binary(max_size=12).map(lambda b: b.replace(b"\xff", b"a")), max_size=40), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_merge(strings, n):
    runs = []
    for i in range(n):
        own = sorted(strings[i::n])
        prefix, tails, sizes = suffixes.front_code(own)
        runs.append(suffixes.Run(prefix, tails, sizes))
    out = list(suffixes.merge(runs))
    assert [s for _, _, s, _ in out] == sorted(strings)
    for (_, _, a, _), (_, _, b, lcp) in zip(out, out[1:]):
        assert lcp == suffixes.shared(a, b, 0)


# common


def test_ids_and_buckets(spark):
    ids = [0, 1, -1, 5, 1 << 40, -(1 << 62), 123456789012]
    df = spark.createDataFrame([(i,) for i in ids], "id long").select("id", tables.id_bucket(7).alias("b"))
    assert [r.b for r in df.collect()] == tables.id_buckets(np.array(ids), 7).tolist()
    x = {"a": np.arange(5), "b": b"bytes", "c": np.array([1.5])}
    back = tables.unpack(tables.pack(x))
    assert back["b"] == b"bytes" and (back["a"] == x["a"]).all() and back["c"][0] == 1.5


def test_later_copies():
    r = np.random.default_rng(3)
    x = {k: r.integers(0, m, 400).astype(t) for k, m, t in (("fp", 6, np.uint64), ("sw", 5, np.uint64), ("id", 4, np.int64), ("tag", 2, np.uint16), ("pos", 5, np.int64))}
    place = list(zip(*(x[k].tolist() for k in ("id", "tag", "pos"))))
    kind = list(zip(x["fp"].tolist(), x["sw"].tolist()))
    first = {}
    for k, p in zip(kind, place):
        first[k] = min(p, first.get(k, p))
    assert sorted(suffixes.later_copies(x).tolist()) == [i for i in range(400) if place[i] > first[kind[i]]]


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_groups_by_hand(seed):
    """Both ways of comparing a group's contexts, and window by window."""
    import random

    r = random.Random(seed)
    gram, length = b"g" * 32, 48
    entries = []
    for i in range(r.randint(2, 40)):
        left = bytes(r.choice(b"ab") if r.random() < 0.2 else 97 for _ in range(r.randint(0, 16)))
        right = bytes(r.choice(b"ab") if r.random() < 0.2 else 97 for _ in range(r.randint(max(0, 16 - len(left)), 16)))
        entries.append((gram + right, left, r.randint(0, 5), 0, i * 100))
    entries.sort()
    first = {}
    for right, left, i, tag, pos in entries:
        for p in range(len(left) + len(right) - length + 1):
            w = (left + right)[p : p + length]
            first[w] = min(first.get(w, (9, 0, 0)), (i, tag, pos + p))
    want = {(i, q) for right, left, i, tag, pos in entries for p in range(len(left) + len(right) - length + 1) if first[(left + right)[p : p + length]] < (i, tag, pos + p) for q in range(pos + p, pos + p + length)}
    for most in (0, 100):
        group = suffixes.Group(length)
        suffixes.PAIRWISE, before = most, suffixes.PAIRWISE
        for k, e in enumerate(entries):
            group.add(e, suffixes.shared(entries[k - 1][0], e[0], 0) if k else 0)
        got = {(i, q) for i, _, a, z in group.close() for q in range(a, z)}
        suffixes.PAIRWISE = before
        assert got == want


def test_large_groups_are_passed_on(monkeypatch):
    """Contexts around one anchor, resolved in one go and window by window."""
    import random

    r = random.Random(4)
    anchor, length = bytes(range(32)), 64
    entries = []
    for i in range(40):
        left, right = bytes(r.choice(b"ab") for _ in range(3)) + b"l" * 12, b"r" * 20 + bytes(r.choice(b"ab") for _ in range(3))
        entries.append((anchor + right, left, i // 2, 0, (i % 2) * 500))
    entries.sort()
    prefix, tails, sizes = suffixes.front_code([e[0] for e in entries])
    blob = {"lcp": prefix, "tails": tails, "sizes": sizes, "left": b"".join(e[1] for e in entries), "lsizes": np.array([len(e[1]) for e in entries])}
    blob |= {k: np.array([e[j] for e in entries], t) for j, k, t in ((2, "id", np.int64), (3, "tag", np.uint16), (4, "pos", np.int64))}

    def unpacked(batches):
        out = {}
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.setdefault(kind, []).append(tables.unpack(data))
        return out

    def spans(blobs):
        return {(i, p) for b in blobs for i, a, z in zip(b["id"].tolist(), b["pos"].tolist(), b["end"].tolist()) for p in range(a, z)}

    def run(make, have):
        fn, end = make()
        return unpacked([*fn(0, have), *end()])

    whole = run(suffixes._merged(length, 4), {0: [blob]})
    assert suffixes.WINDOW not in whole and spans(whole[suffixes.WHOLE])
    monkeypatch.setattr(suffixes, "MOST_GROUP", 3)
    parts = run(suffixes._merged(length, 1), {0: [blob]})
    later = run(suffixes._earliest(length, 4), {suffixes.WINDOW: parts[suffixes.WINDOW]})
    assert spans(later[suffixes.WHOLE]) | spans(parts.get(suffixes.WHOLE, [])) == spans(whole[suffixes.WHOLE])
