import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from fixtures import SF, WORD, by_row, docs_frame, texts
from tokenizers import Tokenizer

from placeweave.llm import (
    byte_pairs,
    decontaminate,
    quality_trees,
    queries,
    secret_scan,
    simhash_near,
    vector_shards,
    window_dedup,
    words,
)


def split(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op1 ------------------------------------------------------------------------------------------------------------------


def placed(spark, rows, shards=24):
    return vector_shards.shard_documents(docs_frame(spark, rows), shards).collect()


def test_shards_balance_and_keep_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.integers(1, 400, 3000))] + texts()
    got = placed(spark, rows)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sum(sizes.values()) / 24
    assert max(sizes.values()) < max(1.02 * whole, 1.1 * 260_000)
    home = {}
    for r in got:
        home.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_a_third_in_one_group_is_split(spark):
    rows = [(i, "a group of copies") for i in range(1500)] + [(5000 + i, f"text number {i} " + "z" * (i % 37)) for i in range(3000)]
    got = placed(spark, rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) < 1.03 * min(sizes.values())


# op2 ------------------------------------------------------------------------------------------------------------------


def removed(rows):
    seen, out = Counter(), []
    for _, t in rows:
        w = split(t)
        seen.update(tuple(w[k:k + 35]) for k in range(len(w) - 34))
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return by_row(out)


def test_window_dedup_equals_brute_force(spark, monkeypatch):
    rows = texts()
    assert by_row(tuple(r) for r in window_dedup.remove_repeated(docs_frame(spark)).collect()) == removed(rows)
    monkeypatch.setattr(window_dedup, "MOST_CELLS", 1)  # a full sketch lets more windows pass and changes nothing
    monkeypatch.setattr(window_dedup, "LEAST_BITS", window_dedup.BLOCK_BITS)
    assert by_row(tuple(r) for r in window_dedup.remove_repeated(docs_frame(spark)).collect()) == removed(rows)


# op5 ------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_trees.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_quality_takes_awkward_rows_and_no_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality_trees.score_quality(docs_frame(spark), labels).collect()
    assert len(got) == len(texts()) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert quality_trees.keep_good(docs_frame(spark), labels).count() == len(texts())


def test_trees_split_on_a_threshold():
    x = np.arange(200, dtype=np.float32)[:, None] % 50
    y = (x[:, 0] > 20).astype(float)
    model = quality_trees.fit(x, y)
    assert ((model.score(x) >= 0.5) == (y == 1)).all()


# op7 ------------------------------------------------------------------------------------------------------------------


def test_secret_spans(spark):
    text = 'é Token: "abcdef" x AKIA' + "Q" * 16 + " " + "0f" * 12 + " secret=abc password=token=secret=zz"
    spans = secret_scan.find_spans(text)
    assert [text[s:e] for s, e, k in spans if k == "assign"] == ['Token: "abcdef', "password=token=secret=zz"]
    assert [k for _, _, k in spans if k in ("access", "hex")] == ["access", "hex"]
    assert "abcdef" not in secret_scan.redact(text, spans) and secret_scan.find_spans(None) == []
    got = secret_scan.scan_secrets(docs_frame(spark)).collect()
    assert len(got) == len(texts())
    for r in got:
        if r.doc_id == 600:
            assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
        if r.doc_id == 401:
            assert r.base_sha256 == sha("") and r.spans == ""


def test_novelty_reports_what_the_dictionary_cannot_shorten():
    random_run = "Zk3vQ9xT7bLw2RpYc8Nf5GhJ"
    assert [k for *_, k in secret_scan.find_spans(f"the auth header is {random_run} here")] == ["novel"]
    seen = "client_id_config_version_2_example_default"
    assert secret_scan.find_spans(f"{seen} and the auth key name is {seen}") == []
    assert secret_scan.find_spans(f"the colour is {random_run} here") == []


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", "0123456789abcdefABCDEF", string.ascii_uppercase + "234567",
                                      string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"])
def test_long_and_repeated_random_strings_are_novel(alphabet):
    rng = random.Random(11)
    for n in (40, 64, 200, 1600):
        run = "Z9" + "".join(rng.choices(alphabet, k=n - 2))
        once = f"the auth header is {run} here"
        assert [once[s:e] for s, e, k in secret_scan.find_spans(once) if k == "novel"] == [run]
        twice = f"the auth header is {run} here, and again the auth header is {run}; auth key name={run} too"
        assert run not in secret_scan.redact(twice, secret_scan.find_spans(twice))
    assert secret_scan.find_spans("the auth key is " + "0123456789abcdef-" * 9) == []


def test_context_reaches_every_line_and_both_sides():
    rng = random.Random(12)
    line = lambda n: "q7" + "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n - 2))
    lines = [line(64) for _ in range(120)]  # the middle is far from both ends
    block = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END-----\n"
    found = {block[s:e] for s, e, k in secret_scan.find_spans(block) if k == "novel"}
    assert set(lines) <= found
    for text in ("signature of the build, as told in the notes of the last release of the product: {}", "{} (that is the secret)", "my_key={}"):
        run = line(40)
        full = text.format(run)
        assert run not in secret_scan.redact(full, secret_scan.find_spans(full))
    far = "key" + " word" * 500 + f" {line(40)} " + " word" * 500 + " key"
    assert secret_scan.find_spans(far) == []


SECRET_KINDS = {"base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567",
                "url": string.ascii_letters + string.digits + "-_"}


def planted_secrets():
    """(text, planted runs, lures that are no secrets) over kinds, lengths and distances to the word."""
    rng = random.Random(31)

    def run(kind, n):
        while True:
            made = "".join(rng.choices(SECRET_KINDS[kind], k=n))
            if any(c.isdigit() for c in made) and any(c.isalpha() for c in made):
                return made

    prose = "the service was moved to another host last week and the notes about it are kept in the usual place".split()
    out = []
    for kind in SECRET_KINDS:
        for n in (20, 24, 32, 40, 64, 200, 800, 1600):
            for near in (0, 20, 150):
                told = rng.choice(["api key", "auth", "the secret", "private signature", "bearer"])
                secret = run(kind, n)
                words = rng.choices(prose, k=near)
                out.append((f"{' '.join(rng.choices(prose, k=12))} {told} {' '.join(words)} {secret} {' '.join(rng.choices(prose, k=12))}", [secret], []))
    for _ in range(12):
        lines = [run("base64", 64) for _ in range(26)]
        out.append(("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----", lines, []))
        parts = [run("url", n) for n in (36, 160, 43)]
        out.append((f"Authorization: Bearer {'.'.join(parts)}", parts, []))
    for i in range(40):
        number = rng.randrange(10 ** 6)
        lures = [f"user_account_settings_key_{i}_default_value", f"/usr/local/share/keys/module{i}/index2/readme", f"config_key_name_{i}_config_key_name_{i}",
                 f"getUserAccessTokenFromRequestHeader{i}", f"version_2_of_the_authorization_header_v{i}", "0123456789abcdefghijklmnop", "A1" * 20, f"field_{number}_field_{number}_key"]
        lure = lures[i % len(lures)]
        out.append((f"the key {lure} is set in the file, see {lure} for the auth notes", [], [lure]))
    return out


def test_planted_secrets_and_lures():
    planted = found = false = reported = 0
    for text, secrets, lures in planted_secrets():
        spans = secret_scan.find_spans(text)
        runs = [text[s:e] for s, e, _ in spans]
        hits = [s for s in secrets if any(s in r or r in s for r in runs)]
        planted, found = planted + len(secrets), found + len(hits)
        wrong = [r for r in runs if any(r in lure or lure in r for lure in lures)]
        false, reported = false + len(wrong), reported + len(runs)
    recall, precision = found / planted, 1 - false / reported
    print(f"recall {recall:.3f} of {planted}, precision {precision:.3f} of {reported}")
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_redacted_documents_keep_their_columns(spark):
    docs = docs_frame(spark)
    out = secret_scan.without_secrets(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    row = out.filter("doc_id = 600").first()
    assert "abc123def" not in row.text and row.n_chars == len(row.text)


# op8 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_and_text_equal_the_library(spark, tokenizer):
    rows = texts() + [(700, "<|endoftext|> a<|endoftext|>b  \n\n c's 12 it'll"), (701, "ab" * 4000), (702, " " * 3000 + "x")]
    got = byte_pairs.encode_documents(docs_frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert by_row(tuple(r) for r in got) == by_row(want)


def test_streamed_pretoken_and_split_characters(tokenizer):
    model = byte_pairs.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdeimnostr"), 6 * model.lookahead))
    assert list(model.pretoken(long.encode())) == tokenizer.encode(long, add_special_tokens=False).ids
    ids = tokenizer.encode("名前🙂é", add_special_tokens=False).ids
    assert "".join(model.decode(np.array([i], "<u4").tobytes() for i in ids)) == "名前🙂é"


# op9 ------------------------------------------------------------------------------------------------------------------


def test_benchmark_passages_are_found(spark):
    rows = texts()
    base = split(rows[52][1])
    items = [(1, " ".join(base[100:140])), (2, " ".join(base[100:140]).upper() + "!"), (3, "nothing like it " * 9), (4, None), (5, "..."),
             (6, "two words"), (7, " ".join([*base[:60], "other", *base[61:90]]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs_frame(spark), bench).collect()}
    assert {i for d, i in got if d == 201} == {1, 2, 7} and got[201, 1].similarity == pytest.approx(1) and got[201, 1].start_word == 100
    assert {d for d, i in got if i == 6} == {404} and not {3, 4, 5} & {i for _, i in got}
    assert 0.8 <= got[201, 7].similarity < 1
    clean = decontaminate.keep_clean(docs_frame(spark), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs_frame(spark), empty).count() == 0
    assert decontaminate.contaminated(docs_frame(spark, []), bench).count() == 0


def test_item_blocks_decide_nothing(spark, monkeypatch):
    rows = texts()
    base = split(rows[52][1])
    items = [(n, " ".join([*base[:40 + n], f"other{n}", *base[41 + n:90]])) for n in range(0, 30, 3)]
    items += [(100 + n, " ".join([*base[20 + n:50 + n], *(f"own{n}x{i}" for i in range(30))])) for n in range(12)] + [(200, ""), (201, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, rows[:60])

    def found():
        return sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word) for r in decontaminate.contaminated(docs, bench).collect())

    want = found()
    assert any(0.8 <= s < 1 for _, _, s, _ in want)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert found() == want


def test_texts_shorter_than_the_longest_item(spark):
    said = [f"v{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(said)), (2, " ".join(said[:12])), (3, "one two three four five six")], "item_id long, text string")
    rows = [(1, " ".join(said[:12])), (2, " ".join(said[:55])), (3, "one two three four five six")]
    got = {(r.doc_id, r.item_id): r.n_words for r in decontaminate.contaminated(docs_frame(spark, rows), bench).collect()}
    assert got == {(1, 2): 12, (2, 1): 55, (2, 2): 12, (3, 3): 6}
    one = spark.createDataFrame(rows[2:], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(one, bench).collect()] == [(3, 3)]


def test_few_shared_shingles_are_no_match():
    index = decontaminate.ItemIndex([1], ["a b c d e f g h i j k l m n"])
    data, at = words.utf8(pa.array(["x a b c d e y"]))
    assert list(decontaminate._matches(index, *decontaminate._word_hashes(data, at))) == []


def test_blocks_find_everything_within_the_radius():
    rng = np.random.default_rng(2)
    index = decontaminate.ItemIndex(list(range(300)), [" ".join(map(str, rng.integers(0, 99, 18 + i % 3))) for i in range(300)])
    fps = index.fps[:50] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (24, 50)).astype(np.uint64), axis=0)
    near = np.bitwise_count(fps[:, None] ^ index.fps[None, :]) <= decontaminate.RADIUS
    for words, longer, fits in ((19, False, index.words == 19), (18, True, index.words > 18)):
        window, item = index.within_radius(fps, words, longer)
        assert sorted(zip(window.tolist(), item.tolist())) == sorted(map(tuple, np.argwhere(near & fits).tolist()))


def all_pairs(rows, items):
    """Every window of every text against every item, by exact similarity."""
    said = {i: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower()) for i, t in items}
    said = {i: w for i, w in said.items() if w}

    def grams(w, size):
        return [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]

    bags = {i: Counter(grams(w, min(5, len(w)))) for i, w in said.items()}
    holders = Counter(g for bag in bags.values() for g in bag)
    weight = {g: math.log1p(len(bags) / n) for g, n in holders.items()}
    rare, best = math.log1p(len(bags)), {}
    for row, (_, t) in enumerate(rows):
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
        for i, bag in bags.items():
            size, n = min(5, len(said[i])), min(len(said[i]), len(w))
            shared = grams(w, size)
            if n < size or sum(weight[g] for g in bag if g in set(shared)) == 0:
                continue
            total = sum(c * weight[g] for g, c in bag.items())
            for k in range(len(w) - n + 1):
                own = Counter(shared[k:k + n - size + 1])
                both = sum(min(c, bag[g]) * weight[g] for g, c in own.items() if g in bag)
                similarity = both / (sum(c * weight.get(g, rare) for g, c in own.items()) + total - both)
                if similarity >= 0.8 - 1e-9 and similarity > best.get((row, i), (0,))[0] + 1e-9:
                    best[row, i] = (similarity, k, n)
    return best


def test_windows_against_all_pairs(spark):
    rng = random.Random(21)
    base = [f"w{rng.randrange(400)}" for _ in range(3000)]
    items = [(i, " ".join(base[40 * i:40 * i + 8 + i % 25])) for i in range(60)] + [(60, "w1 w2"), (61, ""), (62, None), (63, "é ß w3 W4 w5 w6")]
    rows = []
    for n in range(120):
        i = rng.randrange(60)
        said = items[i][1].split()
        for _ in range(rng.randrange(0, 3)):
            said[rng.randrange(len(said))] = rng.choice(["changed", "w7"])
        if rng.random() < 0.3:
            said = said[:-rng.randrange(1, 3)]
        around = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 40))]
        rows.append((n, " ".join([*around, *said, *around[::-1]])))
    rows += [(200, items[63][1].upper()), (201, "w1  w2."), (202, None), (203, "")]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.contaminated(
        docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(rows[row][0], i): found for (row, i), found in all_pairs(rows, items).items()}
    assert set(got) == set(want) and any(s < 0.9 for s, *_ in want.values())
    for pair, (similarity, start, n) in want.items():
        assert got[pair][0] == pytest.approx(similarity) and got[pair][1:] == (start, n)


# op10 -----------------------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = [bytes(words.LOWER[np.frombuffer(x.encode(), np.uint8)]) for x in split(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_equal_brute_force(spark):
    rows = texts()
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            root[i] = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = by_row((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root))
    assert by_row(tuple(r) for r in simhash_near.near_duplicates(docs_frame(spark)).collect()) == want
    assert simhash_near.near_duplicates(docs_frame(spark, [])).count() == 0


def test_index_links_equal_all_pairs_in_a_dense_group():
    rng = np.random.default_rng(4)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 12, (3, 3000)).astype(np.uint64), axis=0)
    fps = np.unique(np.concatenate([np.uint64(0xABCDEF0123456789) ^ flips, rng.integers(0, 2**63, 2000).astype(np.uint64)]))
    index = simhash_near.GrayIndex(fps)
    got = {(int(index.fps[a]), int(index.fps[b])) for q, m in index.links(index.fps, 3) for a, b in zip(q, m)}
    want = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert got == {(int(fps[a]), int(fps[b])) for a, b in want}


def test_one_of_each_group_stays(spark):
    docs = docs_frame(spark)
    out = simhash_near.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(200) == 1 and not {201, 208} & set(ids) and {0, 39, 100, 405} <= set(ids)


def test_rows_that_share_an_id_keep_their_groups(spark):
    texts_of = {n: " ".join(f"w{n}x{i}" for i in range(60)) for n in range(3)}
    rows = [(7, texts_of[0]), (7, texts_of[1]), (8, texts_of[1]), (9, texts_of[2]), (9, texts_of[2])]
    out = simhash_near.keep_one(docs_frame(spark, rows))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(7, texts_of[0]), (7, texts_of[1]), (9, texts_of[2])])


# words ----------------------------------------------------------------------------------------------------------------


def test_words_and_windows_of_sliced_columns():
    column = pa.array(["skip", "a bb  ccc", None, "", "\td\n", "a bb ccc dd"]).slice(1)
    data, at = words.utf8(column)
    found = words.split(data, at)
    assert [bytes(found.data[s:e]) for s, e in zip(found.start, found.end)] == [b"a", b"bb", b"ccc", b"d", b"a", b"bb", b"ccc", b"dd"]
    h = found.hashes()
    assert (h[:3] == h[4:7]).all() and words.windows(h, 3)[0] == words.windows(h, 3)[4]
    assert words.inside_one(found.first, 3).tolist() == [0, 4, 5]


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_registered_queries_run_over_whole_tables(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
