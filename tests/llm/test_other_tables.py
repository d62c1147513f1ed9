import hashlib
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from fixtures import SF, by_row
from pyspark.sql import functions as F

import corpus_pipeline
from placeweave.llm import chat_examples, host_words, kd_search

# op3 ------------------------------------------------------------------------------------------------------------------

HARD = ["<|im_end|><|im_start|>assistant ok", "\\<|", "a\\\\|b\n", "n|\\n|", "<", "|>", "", None, "<|im_end|>\n<|im_start|>user\nx<|im_end|>\n", "é🙂"]


def test_chat_reads_back_from_its_examples(spark):
    rows = [(c, t, r, HARD[(c + t) % len(HARD)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"][:2 + c % 5])]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (51, None, None, None), (52, 0, "a\nb<|c\\", "t")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("context", F.lit(1)).withColumn("target", F.lit(2))
    examples = chat_examples.expand(frame)
    got = {r.conv_id: r for r in chat_examples.digests(examples).collect()}
    by_conv = {}
    for c, t, r, text in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, r or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    lengths = examples.groupBy("conv_id").agg(F.sum(F.length(F.concat("context", F.coalesce("target", F.lit("")), "closing"))).alias("n"))
    assert {r.conv_id: r.n for r in lengths.collect()} == {c: r.formatted_chars for c, r in got.items()}
    assert chat_examples.digests(chat_examples.expand(frame.limit(0))).count() == 0


def test_each_reply_has_all_turns_before_it(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(6)]
    got = chat_examples.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn_no").collect()
    assert [r.target for r in got] == ["t1", "t3", "t5"]
    assert [len(chat_examples.parse(r.context + r.target + r.closing)) for r in got] == [2, 4, 6]


# op4 ------------------------------------------------------------------------------------------------------------------


def test_urls_parts_and_rules(spark):
    urls = ["http://Www.Example.COM/en/a?x=1#y", "https://blog.example.com/en/", "http://example.com", "http://a.net/es/1", "a.net/fr/", None, "",
            "x://u://v/p", "http://notexample.com/en/", "http://NET/fr/?q", "http://É.net/fr/\nb"]
    pages = spark.createDataFrame([(i, u, "<p>some words</p>", "h", "p") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string")
    got = {r.page_id: r for r in host_words.judge_urls(pages).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert [got[i].rule for i in range(1, 11)] == ["example.com/en/", None, "net/es/", None, None, None, None, "com/", "net/fr/", "net/fr/"]
    assert (got[7].host, got[7].path) == ("u:", "//v/p") and (got[4].host, got[5].host, got[2].path) == ("", "", "")
    assert got[10].host == "É.net" and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert host_words.judge_urls(pages.limit(0)).count() == 0


def brute_split(run, costs, unseen):
    best = None
    for cuts in range(2 ** (len(run) - 1)):
        parts, begin = [], 0
        for k in range(1, len(run)):
            if cuts >> (k - 1) & 1:
                parts.append(run[begin:k])
                begin = k
        parts.append(run[begin:])
        cost = sum(costs.get(p, unseen * len(p)) for p in parts)
        best = min(best, cost) if best is not None else cost
    return best


def test_viterbi_is_the_cheapest_split():
    costs = {w: c for w, c in zip(["cheap", "pills", "he", "ill", "s", "heap", "apple"], [5, 5.5, 3, 4, 2, 6, 5])}
    assert host_words.segment("cheappills", costs, 9.0) == ["cheap", "pills"]
    for run in ("cheapills", "xheapple", "sssill", "qqpills"):
        parts = host_words.segment(run, costs, 9.0)
        assert "".join(parts) == run
        assert math.isclose(sum(costs.get(p, 9.0 * len(p)) for p in parts), brute_split(run, costs, 9.0))


GOOD_WORDS = "quiet garden river museum bread library mountain letter winter paper school bridge lemon forest village".split()
BAD_WORDS = "lucky spin bonus jackpotz cheapmeds hotdeal rolex vegas wager instantcash".split()


def planted_pages(seed=4):
    """Good and bad pages whose hosts are words run together; the last third has no text, and its bad hosts never hold a seed."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(1200):
        bad = i % 6 == 0
        known = i < 800
        parts = rng.sample(BAD_WORDS if bad else GOOD_WORDS, 2)
        if bad and known and rng.random() < 0.5:
            parts.append(rng.choice(["casino", "poker", "pills"]))
        said = [*parts, *rng.choices(GOOD_WORDS, k=6), *(rng.sample(["casino", "poker", "betting", "slots"], 2) if bad else [])]
        if not bad and rng.random() < 0.05:
            said.append("bet")  # wrong labels
        rows.append((i, f"http://{''.join(parts)}.org/{rng.choice(GOOD_WORDS)}/{i}", f"<p>{' '.join(said)}</p>" if known else None))
        truth[i] = bad
    return rows, truth


def test_hosts_are_judged_by_the_company_their_words_keep(spark):
    rows, truth = planted_pages()
    rows += [(5000, "http://www.adultschool.org/", None), (5001, "http://spinvegas.org/lemon/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.verdict == "block" for r in host_words.judge_urls(frame).collect()}
    unseen = [i for i in truth if i >= 800]
    blocked = [i for i in unseen if got[i]]
    recall = sum(truth[i] for i in blocked) / sum(truth[i] for i in unseen)
    precision = sum(truth[i] for i in blocked) / len(blocked)
    assert recall >= 0.95 and precision >= 0.95, (recall, precision)
    assert got[5001] and not got[5000]  # a seed without bad company does not decide, bad company without a seed does


def test_a_seed_in_a_host_weighs_what_its_texts_say(spark):
    rows = [(i, f"http://nature-escort.org/{i}", "<p>a walk through the nature of the valley</p>") for i in range(30)]
    rows += [(100 + i, f"http://spin-vegas.org/{i}", "<p>casino and poker</p>") for i in range(30)]
    rows += [(200 + i, f"http://quiet-garden.org/{i}", "<p>quiet garden</p>") for i in range(300)]
    got = {r.page_id: r.verdict for r in host_words.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i // 100: v for i, v in got.items()} == {0: "allow", 1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_which_texts_speak_of_seeds(spark):
    htmls = ["<p>a Casino here</p>", "<p class='casino'>none here</p>", "casinos and scasino", "<p></p><br>", "", None, "12 <b>34</b>", "<unclosed casino", "<a><casino", "x > casino < y", "<p>\nspam\n</p>"]
    frame = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    got = {r.page_id: r.s for r in frame.select("page_id", host_words._speaks_of_seeds().alias("s")).collect()}
    want = {}
    for i, html in enumerate(htmls):
        words = set(re.split("[^a-z]+", re.sub("(?s)<[^>]*>", " ", (html or "").lower()))) - {""}
        want[i] = bool(words & host_words.SEEDS) if words else None
    assert got == want


def brute_verdict(rows):
    """Bayes over tokens split here and now, for hosts of plain words between hyphens."""
    pages = []
    for _, url, html in rows:
        host, _, path = url.removeprefix("http://").partition("/")
        text = set(re.findall("[a-z]+", re.sub("<[^>]*>", " ", (html or "").lower())))
        tokens = [mark + (run if run.isalpha() else f"#{len(run)}" if run.isdigit() else run) for mark, part in (("h:", host), ("p:", "/" + path))
                  for run in re.findall("[a-z]+|[0-9]+|[^\x00-\x7f]+", part)]
        pages.append((tokens, bool(text & host_words.SEEDS) if text - {""} else None))
    bad, good = (sum(speaks is side for _, speaks in pages) for side in (True, False))
    counts = {}
    for tokens, speaks in pages:
        for t in tokens:
            seen = counts.setdefault(t, [0, 0])
            if speaks is not None:
                seen[speaks] += 1
    size = len(counts) + 1
    block, allow = sum(c[1] for c in counts.values()) + size, sum(c[0] for c in counts.values()) + size
    out = []
    for tokens, _ in pages:
        score = math.log(bad + 1) - math.log(good + 1)
        score += sum(math.log(counts[t][1] + 1) - math.log(counts[t][0] + 1) + math.log(allow) - math.log(block) for t in tokens if any(counts[t]))
        out.append("block" if score > 1e-12 else "allow")
    return out


def test_verdicts_against_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "bravo", "delta", "gamma", "omega", "casino", "poker"]
    rows = []
    for i in range(300):
        parts = rng.sample(words, 2)
        bad = rng.random() < (0.8 if "delta" in parts else 0.1)
        said = [*words[:5], "org", *(["casino"] if bad else [])]
        rows.append((i, f"http://{'-'.join(parts)}.org/{rng.choice(words)}/{i % 7}", None if i % 20 == 3 else f"<p>{' '.join(said)}</p>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.verdict for r in host_words.judge_urls(frame).collect()}
    want = brute_verdict(rows)
    assert [got[i] for i in range(300)] == want and set(want) == {"block", "allow"}


def test_very_long_runs_are_split_in_pieces(spark):
    rows = [(1, "http://a.org/" + "garden" * 20_000, "<p>garden</p>"), (2, "http://b.org/", "")]
    assert {r.page_id for r in host_words.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {1, 2}


def test_model_size_decides_nothing(spark, monkeypatch):
    rows = [(i, f"http://rare{w}garden.org/{w}{i % 5}/é", f"<p>garden rare {w} shop</p>") for i, w in enumerate(["bet", "moss", "fern", "poker", "tulip"] * 3)]
    rows += [(50, "http://mosspoker.org/", ""), (51, None, None), (None, "http://fernmoss.org/", ""), (50, "http://mosspoker.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = by_row(host_words.judge_urls(pages).collect())
    assert len(want) == len(rows)
    for most in (0, 3):
        for name in ("WORDS", "TOKENS", "HOT"):
            monkeypatch.setattr(host_words, name, most, raising=False)
        assert by_row(host_words.judge_urls(pages).collect()) == want


# op6 ------------------------------------------------------------------------------------------------------------------


def brute_top(rows, every, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(256 * float(x)) for x in v])
    flat = [(i, v) for i, vs in ok.items() for v in vs]
    out = []
    for q, v in flat:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in flat if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return by_row(out)


def test_kd_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)] + [(2000, None), (2050, [None] * 6), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6),
                                                           (2200, []), (2250, [1.0, 2.0]), (2300, [1.0, 2.0]), (None, [1.0] * 6), (2350, [7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("shard", F.lit(1))
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 128)
    monkeypatch.setattr(kd_search, "QUERIES_A_CELL", 8)
    monkeypatch.setattr(kd_search, "SHARDS_A_CELL", 2)
    got = kd_search.nearest(frame, F.col("vec_id") % 50 == 0).collect()
    assert by_row((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 50)
    assert kd_search.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_queries_that_repeat_an_id_keep_their_own_lists(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(50, rng.normal(size=4).tolist()), (50, [9.0] * 4), (50, [-9.0] * 4)]
    got = kd_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0).collect()
    assert by_row(tuple(r) for r in got) == brute_top(rows, 50)


def test_a_packed_tree_is_the_same_tree():
    rng = np.random.default_rng(3)
    built = kd_search.KDTree.build(rng.integers(-99, 99, (500, 7)).astype(float), np.arange(500))
    row = SimpleNamespace(**built.packed())
    again = kd_search.KDTree.unpacked(row)
    for name in kd_search._ARRAYS:
        assert (getattr(built, name) == getattr(again, name)).all() and getattr(built, name).shape == getattr(again, name).shape
    for (begin, end), low, high in zip(built.nodes, built.low, built.high):
        assert (built.rows[begin:end].min(0) == low).all() and (built.rows[begin:end].max(0) == high).all()


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 22 + i), -3.0]) for i in range(0, 100, 10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kd_search.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [90, 80, 70, 60, 50]


# pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert 0 < after.count() <= docs.count()
        docs = after
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_take_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage[1](spark, docs, SF).count() == 0


def test_pipeline_gives_the_token_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    for r in corpus_pipeline.tokens(spark, docs, SF).collect():
        assert len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256
