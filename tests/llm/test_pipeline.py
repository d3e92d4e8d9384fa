"""The corpus pipeline against the same stages in plain Python."""

import random

import corpus_pipeline
from whence.llm import bpe, secrets
from whence.llm.common import keep

from .test_text_operators import DOCS, naive_cleaned, naive_components, naive_sets


def staged(spark, docs):
    for name, f in corpus_pipeline.STAGES:
        docs = keep(f(spark, docs, ""), name)
    return docs


def test_an_empty_table_stays_empty(spark):
    assert staged(spark, spark.createDataFrame([], DOCS)).collect() == []


def test_odd_rows_and_clashing_columns(spark):
    words = [" ".join(f"word{i}x{j}" for j in range(30 + i)) for i in range(12)]
    rows = [(i, t, ["en", None][i % 2], [None, "s1"][i % 2], None) for i, t in enumerate(words)]
    rows += [(3, words[3], None, "s1", None), (3, words[4] + " and more", "en", "s1", 7), (None, words[5] + " with no id at all", None, None, None), (90, None, None, None, None), (91, "", None, None, None), (92, " \n ", "en", "s1", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = docs.select("*", *[docs.doc_id.alias(n) for n in ("id", "mark", "size", "host", "words", "kept", "key_", "passes", "pattern", "ids", "n_tokens", "text_", "digest", "home")])
    plain = sorted(map(str, staged(spark, docs).collect()))
    assert plain and plain == sorted(map(str, staged(spark, clashing).collect()))


def test_stages_one_after_the_other(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = []
    for _ in range(60):
        w = [word() for _ in range(r.randint(15, 80))]
        texts += [" ".join(w)] * r.choice([1, 1, 3])
        w[len(w) // 2] = word()
        texts.append(" ".join(w) + r.choice(["", "\ntoken = '0123456789abcdef'", "\nAll Rights  reserved", f"\nmy token = '{r.getrandbits(64):016x}'"]))
    texts += [None, "", "a b " * 40]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mixing", "bpe_tokens"]
    steps = []
    for name, f in corpus_pipeline.STAGES:
        docs = keep(f(spark, docs, ""), name)
        steps.append([x.asDict() for x in docs.collect()])
    clean = naive_cleaned(rows)
    assert {x["doc_id"]: x["text"] for x in steps[0]} == clean and any(clean[i] != texts[i] for i in clean)
    good = sorted(clean)
    roots = naive_components(naive_sets([clean[i] for i in good], 5), 80, 100)
    one = [good[i] for i, root in enumerate(roots) if i == root]
    assert sorted(x["doc_id"] for x in steps[1]) == one
    red = {i: secrets.redact(clean[i], secrets.scan(clean[i])) for i in one}
    assert any(red[i] != clean[i] for i in one)
    assert {x["doc_id"]: x["text"] for x in steps[2]} == red and all(x["n_chars"] == len(x["text"]) for x in steps[2])
    taken = [x["doc_id"] for x in steps[3]]
    assert set(taken) <= set(one) and max(map(taken.count, taken)) <= 3 and all(x["text"] == red[x["doc_id"]] for x in steps[3])
    e = bpe.Encoder(bpe.Vocabulary.parsed(bpe.tokenizer_text()))
    assert sorted((x["doc_id"], tuple(x["ids"])) for x in steps[4]) == sorted((i, tuple(next(e.encode([red[i]])))) for i in taken)
    assert all(x["n_tokens"] == len(x["ids"]) for x in steps[4])
