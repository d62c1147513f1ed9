"""Small tables with the awkward rows every operator must take, and brute-force answers."""

import random
import re

SF = "/root/testdata/sf0.001"
#: Columns beyond those of the tables, named like the operators' own.
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, fp long, size long, mark long, stats string, "
        "tokens string, n int, unit string, score double, spans string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return [rng.choice("the of and to in that is was for on with as by this be at from").replace(" ", "x") + str(rng.randrange(900))
            for _ in range(n)]


def texts():
    rng = random.Random(5)
    base = words(rng, 400)
    shared = words(rng, 60)
    out = [(i, " ".join(words(rng, rng.randrange(1, 300)))) for i in range(40)]
    out += [(100 + i, " ".join(words(rng, 50) + shared + words(rng, 20))) for i in range(12)]
    out += [(200 + i, " ".join(base)) for i in range(9)]
    out += [(300 + i, " ".join(base[:100 + 30 * i] + ["changed"] + base[101 + 30 * i:])) for i in range(6)]
    out += [(400, None), (401, ""), (402, " \t\n "), (403, "one"), (404, "two words"), (405, "é ü\u00a0ß \u2028 名前 🙂"), (406, "la " * 300)]
    out += [(500, "x" * 5000), (501, "\n".join(["same line of text"] * 80)), (502, " ".join(words(rng, 40_000)))]
    out += [(None, "a row without an id"), (None, None), (7, "another text under a used id"), (200, " ".join(base)), (200, " ".join(base))]
    out += [(600, 'password = "abc123def" token: x AKIA' + "B" * 16 + " " + "0a" * 15 + " api_key=short")]
    return out


def docs_frame(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "s", "t", 4, "u", 0.5, "p") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def by_row(rows):
    return sorted(rows, key=repr)
