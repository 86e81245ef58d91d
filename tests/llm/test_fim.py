"""Fill-in-middle against a plain rewrite of its rules, and exact round trips."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from evidara.llm import fim

SCHEMA = "doc_id long, text string, n string, form string, output string, `__text` string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


def brute(key, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_equals_brute_force_and_restores(spark):
    r = np.random.Generator(np.random.PCG64(1))
    signs = list("ab Zé\n😀<>PSM7\t \x00") + ["<P", "S>", "word", " "]
    rows = [(None, None), (None, "a b"), (0, ""), (1, "x"), (1, "x"), (2, "a<P>b"), (3, "<S>"), (4, "<M>"), (5, "<<P"), (6, "é" * 50)]
    rows += [(10 + i, "".join(r.choice(signs, int(r.integers(0, 60))))) for i in range(400)]
    made = fim.fill_in_middle(frame(spark, rows)).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: (str(x[0]), str(x))
    got = sorted([(x.doc_id, x.n, x.form, x.output, x.prefix_chars, x.middle_chars) for x in made], key=key)
    assert got == sorted([(i, *brute(i, t)) for i, t in rows], key=key)
    assert sorted((str(x.doc_id), x.again) for x in made) == sorted((str(i), t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {x.form for x in made}


def test_long_texts_in_pieces(spark):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(fim.SINGLE_PATTERN), behavior="isolated")
    text = ("wörd ab " * 40 + "x" * 500 + " ") * 3
    expected = [m.start() for m in re.finditer(fim.TOKEN_PATTERN, text)]
    for piece in (1, 7, 100, 10_000):
        assert fim.token_starts(text, split, piece).tolist() == expected
    long = [(1, "ab " * 700_000), (2, "z" * 2_000_000), (3, "é" * 600_000)]
    made = {x.doc_id: x for x in fim.fill_in_middle(frame(spark, long)).collect()}
    assert all((made[i].n, made[i].form, made[i].output) == brute(i, t)[:3] for i, t in long)


def test_empty_table(spark):
    assert fim.fill_in_middle(frame(spark, [])).count() == 0


def test_another_seed_cuts_elsewhere(spark):
    docs = frame(spark, [(i, "one two three four five six seven") for i in range(50)])
    one, two = ({x.doc_id: x.output for x in fim.fill_in_middle(docs, seed=s).collect()} for s in (1, 2))
    assert one != two
