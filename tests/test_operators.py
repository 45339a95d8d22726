"""Literal cases of the core operators."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import schedule as L
from sparkloom.functions import text as X
from sparkloom.functions import vectors as V
from sparkloom.operators import batching as B
from sparkloom.operators import beam as BM
from sparkloom.operators import boxes as D
from sparkloom.operators import catalog as C
from sparkloom.operators import corpus as K
from sparkloom.operators import history as H
from sparkloom.operators import metrics as M
from sparkloom.operators import mips as I
from sparkloom.operators import quantize as Q
from sparkloom.operators import sampling as P
from sparkloom.operators import sid as S


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<li>Oak <i>shelf</i> 40 cm</li>", "Oak shelf 40 cm"), ("oak \r\n\t  shelf ", "oak shelf"), ("Lamp red lamp LAMP small red", "Lamp red small"), ("", ""),
        (None, ""), ("a  b", "a b"), ("A b a B c", "A b c"),
    ],
)
def test_clean_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.clean_text(F.col("t")).alias("x")).first().x == want


def test_clean_text_truncates(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(200)),)], "t string")
    got = df.select(X.clean_text(F.col("t"), 100).alias("x")).first().x
    assert len(got) <= 100 and not got.endswith(" ")


def test_clean_text_query_keeps_titles_to_200(spark, tmp_path):
    import __spark_entry__ as entry

    words = [f"word{i:03d}" for i in range(40)]  # seven letters and a space each
    title, longer = "A hex bolt of zinc plated steel, M8 x 40 mm, fully threaded, bag of 100", " ".join(words)
    rows = [(1, title, None), (2, longer, longer + " " + longer.replace("word", "more")), (3, None, None)]
    spark.createDataFrame(rows, "item_id bigint, title string, description string").write.parquet(str(tmp_path / "catalog.parquet"))
    got = {r.item_id: (r.title, r.description) for r in entry.queries()["clean_text"](spark, str(tmp_path)).collect()}
    assert got[1] == ("A hex bolt of zinc plated steel, M8 x 40 mm, fully threaded, bag 100", "") and got[3] == ("", "")
    assert got[2][0] == " ".join(words[:25]) and len(got[2][0]) == 199 and len(got[2][1]) == 500


def test_prompts_and_sid_strings(spark):
    assert one(spark, X.metadata_prompt(F.col("t"), F.col("c"), F.col("d")), t="Saw", c="Unknown", d="") == "<seq> title: Saw"
    assert one(spark, X.metadata_prompt(F.col("t"), F.col("c"), F.col("d")), t="Saw", c="Tools", d="Cuts") == "<seq> title: Saw | category: Tools | description: Cuts"
    assert one(spark, X.sid_target([F.lit(0), F.lit(17), F.lit(1023), F.lit(9)])) == "<sid_0><sid_17><sid_1023><sid_9><sid_eos>"
    assert one(spark, X.parse_sids(F.lit("<seq> <sid_1><sid_2><sid_3>"))) is None
    assert one(spark, X.parse_sids(F.lit("<sid_1><sid_2><sid_3><sid_4><sid_5>"))) == [1, 2, 3, 4]
    assert one(spark, X.shard_path("i", F.lit(12345))) == "i/012/12345.jpg"
    assert one(spark, X.shard_path("i", F.lit(0))) == "i/000/0.jpg"
    assert one(spark, X.shard_path("i", F.lit(1234567))) == "i/1234/1234567.jpg"


def test_sequential_ids_keep_order(spark):
    got = C.sequential_ids(spark.createDataFrame([("Z", 2), ("M", 1), ("A", 0)], "k string, n int"), ["n"]).orderBy("item_id").collect()
    assert [(r.k, r.item_id) for r in got] == [("A", 0), ("M", 1), ("Z", 2)]
    assert C.sequential_ids(spark.createDataFrame([], "n int"), ["n"]).collect() == []


def test_temporal_split_at_the_cutoffs(spark):
    day = C.DAY_MS
    newest = 100 * day
    times = {"new": newest, "edge7": newest - 7 * day, "in7": newest - 7 * day + 1, "edge14": newest - 14 * day, "in14": newest - 14 * day + 1, "zero": 0}
    items = spark.createDataFrame([(k,) for k in [*times, "none"]], "parent_asin string")
    acts = spark.createDataFrame([(k, t) for k, t in times.items()] + [("other", newest + 50 * day), ("new", None)], "parent_asin string, timestamp_ms bigint")
    got = {r.parent_asin: r.split for r in C.temporal_splits(items, acts).collect()}
    assert got == {"new": "test", "edge7": "val", "in7": "test", "edge14": "train", "in14": "val", "zero": "train", "none": "train"}
    empty = spark.createDataFrame([], "parent_asin string, timestamp_ms bigint")
    assert {r.split for r in C.temporal_splits(items, empty).collect()} == {"train"}


def test_last_wins_and_limits(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "y"), ("a", 3, None), ("b", 1, "z")], "k string, n int, v string")
    assert sorted((r.k, r.n, r.v) for r in C.last_wins(df, ["k"], ["n"]).collect()) == [("a", 3, None), ("b", 1, "z")]
    assert C.first_per_group(df, "k", ["n"], 2).count() == 3
    assert C.anti(df, spark.createDataFrame([("a",)], "k string"), ["k"]).count() == 1


EVENTS = [("u1", "B", 200, 1), ("u1", "A", 100, 2), ("u1", "C", 300, 3), ("u2", "X", 1, 4), ("u3", "P", 5, 6), ("u3", "Q", 5, 5)]


def events(spark):
    return spark.createDataFrame(EVENTS, "user_id string, item string, timestamp_ms bigint, ordinal bigint")


def test_chains(spark):
    got = {r.user_id: r.chain for r in H.chains(events(spark), "item").collect()}
    assert got == {"u1": ["A", "B", "C"], "u2": ["X"], "u3": ["Q", "P"]}
    assert {r.user_id: r.chain for r in H.chains(events(spark), "item", cap=2, min_length=2).collect()} == {"u1": ["B", "C"], "u3": ["Q", "P"]}
    last = {r.user_id: (r.history, r.target) for r in H.split_last(H.chains(events(spark), "item")).collect()}
    assert last == {"u1": (["A", "B"], "C"), "u3": (["Q"], "P")}


def test_samples_are_stable_and_exact(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = {r.k for r in P.sample_exact(df, "k", 10, 1).collect()}
    assert len(a) == 10 and a == {r.k for r in P.sample_exact(df.repartition(7), "k", 10, 1).collect()}
    assert {r.part for r in P.tail_split(P.shuffled(df, "k", 3), 0.001).collect()} == {"train", "val"}
    assert P.tail_split(P.shuffled(df, "k", 3), 0.1, most=2).filter("part = 'val'").count() == 2


def test_batches_are_uniform_and_alternate(spark):
    slots = B.paired_slots(spark.range(50).select(F.col("id").alias("k")), spark.range(40).select((F.col("id") + 100).alias("k")), "k", 1)
    assert slots.count() == 80
    assert sorted(r.ordinal for r in slots.collect()) == list(range(80))
    batches = B.uniform_batches(slots, 16, 1, 0).collect()
    assert {r.mode for r in batches if r.batch_id % 2 == 0} == {"sequence"} and len(batches) == 64
    assert B.uniform_batches(slots, 16, 1, 0, drop_last=False).count() == 80
    assert B.paired_slots(spark.range(0).select(F.col("id").alias("k")), spark.range(4).select(F.col("id").alias("k")), "k", 1).count() == 0
    assert B.paired_slots(spark.range(9).select(F.col("id").alias("k")), spark.range(9).select(F.col("id").alias("k")), "k", 1, cap=1).count() == 2


SIDS = [(1000, 0, 1, 2, 3), (1001, 0, 1, 4, 5), (1002, 6, 7, 8, 9), (999, 6, 7, 8, 9)]


def item2feat(spark):
    return spark.createDataFrame(SIDS, "item_id bigint, sid_0 bigint, sid_1 bigint, sid_2 bigint, sid_3 bigint")


def test_sid_lookup_and_collisions(spark):
    f = item2feat(spark)
    assert {tuple(r)[:4]: r.item_id for r in S.sid_to_item(f).collect()}[(6, 7, 8, 9)] == 999
    (c,) = S.collisions(f).collect()
    assert (c.n_items, c.item_ids) == (2, [999, 1002])
    assert tuple(S.collision_stats(f).first())[:4] == (4, 3, 1, 1)
    assert tuple(S.collision_stats(f.limit(0)).first())[:4] == (0, 0, 0, 0)


def test_trie(spark):
    t = S.trie_levels(item2feat(spark))
    assert [x.count() for x in t] == [2, 2, 3, 3]
    probe = spark.createDataFrame([(0, 1, 2, 3), (0, 1, 2, 5), (1, 1, 1, 1)], "sid_0 bigint, sid_1 bigint, sid_2 bigint, sid_3 bigint")
    assert sorted(r.valid for r in S.is_valid(t, probe).collect()) == [False, False, True]
    kids = S.children(t, spark.createDataFrame([(0, 1), (5, 5)], "sid_0 bigint, sid_1 bigint")).collect()
    assert sorted(r.sid_2 for r in kids) == [2, 4]


def test_beam_search_gives_nearest_paths_and_fills_with_misses(spark):
    import numpy as np

    books = [np.eye(10)[:10] * s for s in (1.0, 0.5, 0.25, 0.125)]
    r = BM.Retriever.of(item2feat(spark), BM.quantiser_scorer(spark, books), 10)
    q = (np.eye(10)[0] + np.eye(10)[1] * 0.5 + np.eye(10)[2] * 0.25 + np.eye(10)[3] * 0.125).tolist()
    got = r.search(spark.createDataFrame([(7, q)], "query_id bigint, state array<double>"), k=10).orderBy("rank").collect()
    assert len(got) == 10 and got[0].item_id == 1000 and [x.item_id >= 0 for x in got] == [True] * 3 + [False] * 7
    assert all(x.score > -1e8 for x in got[:3]) and all(x.score < -1e8 for x in got[3:])
    assert len(r.search(spark.createDataFrame([(7, q)], "query_id bigint, state array<double>"), k=2, beams=2).collect()) == 2
    free = r.search(spark.createDataFrame([(7, q)], "query_id bigint, state array<double>"), k=10, constrained=False).collect()
    assert len(free) == 10 and any(x.item_id == -1 for x in free)
    with pytest.raises(ValueError):
        BM.Retriever.of(spark.createDataFrame([(1,)], "item_id bigint"), r.scorer, 10)
    assert BM.check_beams(10, [5, 50]) == 50


def test_mask_of_known_dead_and_late_slots(spark):
    """A known prefix allows its children, one that no item has allows every code, and so does the fifth slot."""
    t = S.trie_levels(item2feat(spark))
    allowed = lambda rows, slot: {tuple(r)[:slot]: r.n for r in BM.mask_slots(spark.createDataFrame(rows, ", ".join(f"sid_{i} bigint" for i in range(slot))), t, 10, slot).groupBy(*[f"sid_{i}" for i in range(slot)]).agg(F.count_if(~F.col("blocked")).alias("n")).collect()}
    assert allowed([(0, 1), (6, 7), (0, 9), (5, 5)], 2) == {(0, 1): 2, (6, 7): 1, (0, 9): 10, (5, 5): 10}
    assert allowed([(0, 1, 2, 3), (9, 9, 9, 9)], 4) == {(0, 1, 2, 3): 10, (9, 9, 9, 9): 10}


def test_search_from_text(spark):
    f = item2feat(spark).filter("item_id <> 999")
    texts = {1000: ["red", "pan"], 1001: ["blue", "pan"], 1002: ["desk", "lamp"]}
    words = spark.createDataFrame(list(texts.items()), "item_id bigint, words array<string>")
    r = BM.Retriever.of(f, BM.text_scorer(words.join(f, "item_id").drop("item_id"), 10), 10)
    q = spark.createDataFrame([(1, ["blue", "pan"]), (2, ["lamp"]), (3, ["red", "unknown"]), (4, [])], "query_id bigint, state array<string>")
    top = {x.query_id: x.item_id for x in r.search(q, k=1, beams=2).filter("rank = 1").collect()}
    assert (top[1], top[2], top[3]) == (1001, 1002, 1000) and top[4] in texts
    m = {x.metric: x.value for x in r.evaluate(q, spark.createDataFrame([(1, 1001), (2, 1000)], "query_id bigint, target bigint"), [1, 3], beams=1).collect()}
    assert m["recall@1"] == 0.5 and m["recall@3"] == 1.0


def test_stored_index_and_corpus_rows(spark, tmp_path):
    S.store_index(item2feat(spark), str(tmp_path))
    trie, lookup = S.load_index(spark, str(tmp_path))
    assert [x.count() for x in trie] == [2, 2, 3, 3] and lookup.count() == 3
    c = spark.createDataFrame([("behavior", "a", "b", 0), ("metadata", "c d", "<sid_1><sid_2><sid_3><sid_4><sid_eos>", 1)], "seq_type string, input_text string, target_text string, ordinal bigint")
    assert [tuple(r) for r in K.behaviour_only(c).collect()] == [("a", "b")] and K.behaviour_only(c.drop("seq_type")).count() == 2
    assert [r.input_text for r in K.rows_at(c, [1, 9]).collect()] == ["c d"]
    t = {r.step: r.value for r in K.trace_row(c, "metadata", ["ordinal"], max_target=3).collect()}
    assert (t["codes"], t["input_words"], t["target_tokens"], t["kept_tokens"], t["ends"]) == ("1 2 3 4", "2", "5", "3", "true")


def test_training_by_moving_averages(spark):
    """Two codes in one dimension: counts and sums move by 1 - decay, losses are those before the step."""
    import numpy as np

    df = spark.createDataFrame([(i, [v]) for i, v in enumerate((1.0, 3.0, 11.0))] + [(9, None)], "item_id bigint, embedding array<double>")
    books, history = Q.train(df, [np.array([[0.0], [10.0]]), np.array([[0.0], [1.0]])], decay=0.5, epsilon=0.0)
    # level 0: 1 and 3 go to code 0, 11 to code 1; residuals 1, 3, 1 all go to code 1 of level 1
    assert np.allclose(books[0].ravel(), [(0.5 * 0 + 0.5 * 4) / (0.5 + 1.0), (0.5 * 10 + 0.5 * 11) / (0.5 + 0.5)])
    assert np.allclose(books[1].ravel(), [0.0, (0.5 * 1 + 0.5 * 5) / (0.5 + 1.5)])
    assert np.allclose(history, [(1, 4 / 3, 1 / 3)])
    _, longer = Q.train(df, books, epochs=4, batches=1, decay=0.5)
    assert len(longer) == 4 and longer[-1][1] < history[0][1] and longer[0][0] == 1
    seeded = Q.seeded_codebooks(df.filter("item_id < 3"), 1, 2, "item_id", "embedding")
    assert np.allclose(seeded[0].ravel(), [1.0, 7.0])


def test_positions_of_a_hot_user(spark):
    rows = [("hot", f"i{k}", (k * 37) % 500, k) for k in range(500)] + [("cold", "x", 5, 1), ("cold", "y", 5, 0), (None, "n", 1, 0), (None, "m", 2, 0)]
    df = spark.createDataFrame(rows, "user_id string, item string, timestamp_ms bigint, ordinal bigint").repartition(5)
    got = {(r.user_id, r.item): (r.position, r.n_events, r.from_end) for r in H.positions(df).collect()}
    order = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[3]))
    assert all(got[("hot", r[1])] == (k, 500, 500 - k) for k, r in enumerate(order))
    assert got[("cold", "y")] == (0, 2, 2) and got[("cold", "x")] == (1, 2, 1) and got[(None, "m")] == (1, 2, 1)


def test_quantiser(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "item_id bigint, embedding array<double>")
    books = Q.fit(df.filter("item_id < 90"), levels=2, codes=4)
    got = {r.item_id: (r.sid_0, r.sid_1) for r in Q.assign(df, books).collect()}
    assert len(got) == 60
    for i, v in enumerate(x):
        rest, want = v, []
        for b in books:
            want.append(int(((rest - b) ** 2).sum(axis=1).argmin()))
            rest = rest - b[want[-1]]
        assert got[i] == tuple(want)


def test_mips_and_metrics(spark):
    cat = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (30, [0.0, 0.0, 1.0]), (31, [0.0, 0.0, 1.0])], "item_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [0.9, 0.1, 0.0]), (2, [0.0, 0.2, 0.9])], "query_id bigint, q array<double>")
    ranked = I.mips_topk(q, cat, 9)
    top = {(r.query_id, r.rank): r.item_id for r in ranked.collect()}
    assert (top[(1, 1)], top[(2, 1)], top[(2, 2)]) == (10, 30, 31) and len(top) == 8
    targets = spark.createDataFrame([(1, 20), (2, 77)], "query_id bigint, target bigint")
    m = {r.metric: r.value for r in M.recall_ndcg(ranked, targets, [1, 2]).collect()}
    assert m["recall@1"] == 0.0 and m["recall@2"] == 0.5 and math.isclose(m["ndcg@2"], 0.5 / math.log2(3))
    assert {r.value for r in M.recall_ndcg(ranked, targets.limit(0), [1]).collect()} == {0.0}
    gen = spark.createDataFrame([(1,), (2,)], "sid_0 bigint")
    assert M.miss_rate(gen, spark.createDataFrame([(1,)], "sid_0 bigint"), ["sid_0"]).first().rate == 0.5
    assert M.miss_rate(gen.limit(0), gen, ["sid_0"]).first().rate == 0.0
    back = M.misses_last(spark.createDataFrame([(1, 1, -1), (1, 2, 5), (1, 3, -1), (1, 4, 6)], "query_id bigint, rank int, item_id bigint"))
    assert [r.item_id for r in back.orderBy("rank").collect()] == [5, 6, -1, -1]


def test_contrastive_loss_bounds(spark):
    import numpy as np

    eye = np.eye(6)
    df = spark.createDataFrame([(i, eye[i].tolist(), eye[i].tolist()) for i in range(6)], "pair_id bigint, image array<double>, text array<double>").withColumn("batch_id", F.lit(0))
    swapped = spark.createDataFrame([(i, eye[i].tolist(), eye[(i + 1) % 6].tolist()) for i in range(6)], "pair_id bigint, image array<double>, text array<double>").withColumn("batch_id", F.lit(0))
    assert I.infonce(df, 3.0).first().loss < 0.01 < I.infonce(swapped, 3.0).first().loss
    assert I.in_batch_recall(df, 1).first().recall == 1.0


def test_vectors(spark):
    assert one(spark, V.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    assert math.isclose(one(spark, V.norm(V.normalise(F.array(F.lit(3.0), F.lit(4.0))))), 1.0, abs_tol=1e-6)
    assert one(spark, V.affine([[1.0, 0.0], [1.0, 1.0]], [0.5, 0.0], F.array(F.lit(2.0), F.lit(3.0)))) == [2.5, 5.0]


def test_anchored_step_shrinks_to_the_start(spark):
    df = spark.createDataFrame([(i, float(t)) for i, t in enumerate((6, 4, 7, 3))], "i int, theta double").withColumns({"m": F.lit(0.0), "v": F.lit(0.0)})
    new = L.anchored_adamw(F.col("theta"), F.col("m"), F.col("v"), F.lit(5.0), F.lit(0.0), 1, lr=0.1, decay=0.01)
    for r in df.select("theta", new["theta"].alias("t")).collect():
        assert abs(r.t - 5) < abs(r.theta - 5) and (r.t - 5) * (r.theta - 5) > 0
    with pytest.raises(ValueError):
        L.anchored_adamw(F.col("theta"), F.col("m"), F.col("v"), F.lit(5.0), F.lit(0.0), 1, lr=-1)
    assert L.optimiser_steps(3, 4, 2) == 2 and L.parse_ks("10,50,10") == [10, 50]


def test_schedules_at_literal_steps(spark):
    """Step 0 of 100 warm-up steps is 1/100, step 99 is 1; half of the way down is 1/2."""
    at = lambda s, w=100: spark.range(1).select(L.warmup_cosine(F.lit(s), w, 1000).alias("x")).first().x
    assert [round(at(s), 9) for s in (0, 1, 99, 100, 550, 1000, 2000)] == [0.01, 0.02, 1.0, 1.0, 0.5, 0.0, 0.0]
    assert at(0, 0) == 1.0
    assert L.optimiser_steps(100, 4, 2, max_steps=7) == 7 and L.optimiser_steps(0, 4, 3) == 3


def test_boxes(spark):
    d = spark.createDataFrame([(1, 0.5, 0.0, 0.0, 9.0, 9.0), (1, 0.9, 5.0, 5.0, 55.0, 55.0), (2, 0.1, -50.0, -50.0, 500.0, 500.0)], "image_id int, score double, x0 double, y0 double, x1 double, y1 double")
    best = D.best_box(d).withColumns({"width": F.lit(200), "height": F.lit(200)})
    got = {r.image_id: (r.score, r.crop_x0, r.crop_x1, r.cropped) for r in D.clamp(best).collect()}
    assert got == {1: (0.9, 5, 55, True), 2: (0.1, 0, 200, False)}


def test_sequence_queries(spark):
    f = spark.createDataFrame([(i, i, i + 100, i + 200, i + 300) for i in range(4)], "item_id bigint, sid_0 bigint, sid_1 bigint, sid_2 bigint, sid_3 bigint")
    e = spark.createDataFrame([("u1", i, (i + 1) * 100, i) for i in range(4)] + [("u2", 0, 1, 9)], "user_id string, item_id bigint, timestamp_ms bigint, ordinal bigint")
    (r,) = K.sequence_queries(e, f).collect()
    assert r.target == 3 and r.query_text == "<seq> " + "".join(f"<sid_{i}><sid_{i + 100}><sid_{i + 200}><sid_{i + 300}>" for i in range(3))
    assert K.sequence_queries(e, f, min_history=2, max_history=1).collect() == []
    (b,) = K.behaviour_rows(e, f).collect()
    assert b.input_text == r.query_text and b.target_text == "<sid_3><sid_103><sid_203><sid_303><sid_eos>"


def test_schema_check(spark):
    with pytest.raises(ValueError, match="embedding"):
        schemas.check(spark.createDataFrame([(1,)], "item_id bigint"), "embeddings")
