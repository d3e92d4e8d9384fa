"""Corpus operators that work on single texts, against brute force, the tokenizers library and exact round trips."""

import hashlib
import json
import random
import re

import pytest

from whence.llm import bpe, chat, html, language, ngram_join, quality, secrets, winnowing
from whence.llm.mixing import route, targets_of
from whence.llm.sharding import hilbert_indices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [None, "", " \n\t", "é\x00 ſ", "a b c", "x" * 5000, "Hi the there " * 300, "日本語 テキスト 😀", "<|endoftext|> a", "\\ \\\\ [INST] </s>", "1234567812345678 deadbeefdeadbeef"]


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- secrets
def naive_base(text):
    out = []
    for kind, rx, least in (("assign", secrets.ASSIGN, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 18), ("hex", re.compile(r"[0-9a-f]+"), 16)):
        for m in rx.finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(3)
    for _ in range(400):
        t = "".join(r.choice(["token", "TOKEN", "api_key", "apikey", "passwd", "=", ":", ' "', "'", " ", "AKIA", "A1B2C3D4E5F6G7", "deadbeef", "0123456789abcdef", "xyz", "é", "\n"]) for _ in range(r.randint(0, 40)))
        assert [s for s in secrets.scan(t) if s[2] != "novel"] == naive_base(t)


def test_novelty_reports_random_strings_in_context_only():
    assert [k for _, _, k in secrets.scan("the session credential is kX9fQ2mZ7pLw4RtY8vBn, keep it")] == ["novel"]
    assert not secrets.scan("the session credential is kept in configuration_settings, see there")
    assert not secrets.scan("a long name kX9fQ2mZ7pLw4RtY8vBn in no context")
    assert secrets.redact("a token=abcdefabcdef1234 b", secrets.scan("a token=abcdefabcdef1234 b")) == "a [assign removed] b"


def test_whole_keys_and_tokens_are_spanned():
    r = random.Random(5)
    chars = "".join(chr(x) for x in (*range(48, 58), *range(65, 91), *range(97, 123)))
    some = lambda n: "".join(r.choice(chars) for _ in range(n - 2)) + r.choice("0123456789") + r.choice("abc")
    marked = lambda t: secrets.redact(t, secrets.scan(t))
    assert marked(f"the credential is {some(9000)}, keep it") == "the credential is [novel removed], keep it"
    for end in ("\n", "\r\n", "\\n", "\n    "):
        for tail in (64, 20, 7, 1):
            key = end.join([*[some(64) for _ in range(24)], some(64)[:tail]])
            assert marked(f"-----BEGIN PRIVATE KEY-----{end}{key}{end}-----END PRIVATE KEY-----\nand on") == f"-----BEGIN PRIVATE KEY-----{end}[novel removed]{end}-----END PRIVATE KEY-----\nand on"
    assert marked(f"Authorization: Bearer {some(36)}.{some(90)}.{some(43)} more.") == "Authorization: Bearer [novel removed] more."
    assert marked(f"the session is {some(24)}.{some(6)}.{some(27)}\nKeep it") == "the session is [novel removed]\nKeep it"
    first, more = some(64), "\n".join(some(64) for _ in range(5))
    assert marked(f"secret = {first}\n{more}\n\nRegards") == "[assign removed]\n[novel removed]\n\nRegards"
    names = "configuration_settings_one\nnumber_of_sessions_open\n"
    assert marked(f"the credential is {some(20)}\n{names}{some(20)}\nand on") == f"the credential is [novel removed]\n{names}[novel removed]\nand on"
    many = "auth_configuration_settings_of_all\n" * 20_000 + "token " * 50_000
    assert not secrets.scan(many)


def planted_secrets(r):
    """Texts with a secret (and where it stands), and texts without one, both with sensitive words and long names."""
    letters = "".join(chr(x) for x in (*range(48, 58), *range(65, 91), *range(97, 123)))
    some = lambda n, chars=letters: "".join(r.choices(chars, k=n - 2)) + r.choice("23456789") + r.choice("kqz")
    plain = lambda: " ".join("".join(r.choices("aeioulnrst", k=r.randint(2, 9))) for _ in range(30))
    shapes = ["the credential is {}", "Authorization: Bearer {}", 'pwd = "{}"', "session id {} was opened", 'auth("{}")', "private key\n{}", "token = '{}'", 'secret: "{}"']
    for _ in range(40):
        for shape in shapes:
            value = some(r.randint(10, 14), letters + "!@#$%^&*") if shape.startswith(("pwd", "auth")) else some(r.choice([20, 32, 64, 200]))
            head = f"{plain()}\n{shape.partition('{}')[0]}"
            yield f"{head}{value}{shape.partition('{}')[2]}\n{plain()}", (len(head), len(head) + len(value))
        name = r.choice(["configuration_settings_2", "number_of_sessions_v1", "src/main/resources/config", "access_token_placeholder_1", "xxxxxxxxxxxxxxxxxxxx1a", "your_password_here_your_api_key_1a"])
        yield f"{plain()}\nthe {r.choice(['session', 'credential', 'auth'])} of {name} is in {name}\n{plain()}", None


def test_planted_secrets_are_found_and_clean_texts_left_alone():
    r, caught, whole, planted, wrong, clean = random.Random(12), 0, 0, 0, 0, 0
    for text, at in planted_secrets(r):
        spans, measured = secrets.scan_measured(text)
        assert all(e - s == len(text[s:e]) and added >= 0 for s, e, added in measured)
        if at is None:
            clean += 1
            wrong += bool(spans)
        else:
            planted += 1
            caught += any(k == "novel" and s <= at[0] and at[1] <= e for s, e, k in spans)
            whole += text[at[0] : at[1]] not in secrets.redact(text, spans)
    assert planted == 320 and caught >= 0.97 * planted and whole >= 0.98 * planted and wrong <= 0.05 * clean


def test_stems_cover_all_sensitive_words():
    for word in ("password", "PASSWD", "passphrase", "pwd", "Secret", "token", "api key", "API_KEY", "apikey", "Auth", "bearer", "credential", "private-key", "access key", "signature", "session"):
        assert secrets.SENSITIVE.fullmatch(word) and any(x in word.lower() for x in secrets.STEMS)


def test_novelty_of_what_fixed_patterns_cover():
    text = 'a note: token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and on'
    spans, measured = secrets.scan_measured(text)
    assert [k for *_, k in spans] == ["assign", "hex", "novel"] and len(measured) == 1 and text[measured[0][0] : measured[0][1]].startswith("04db")
    again = f"{text} {text}"  # the second adds nothing to its surroundings, nor the first
    assert [k for *_, k in secrets.scan(again)] == ["assign", "hex"] * 2 and len(secrets.scan_measured(again)[1]) == 2
    many = "token " + "deadbeefdeadbeef1 " * 30_000  # many base spans beside many candidates
    assert len(secrets.scan_measured(many)[1]) == 30_000


def test_secret_queries_on_awkward_rows(spark):
    df = frame(spark, [*AWKWARD, "token = '0123456789abcdef'"])
    rows = {r.doc_id: r for r in secrets.secret_digests(df.withColumn("spans", df.lang)).collect()}
    assert len(rows) == len(AWKWARD) + 1 and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""
    assert rows[len(AWKWARD)].n_assign == 1 and rows[len(AWKWARD)].n_hex == 1
    assert secrets.redacted(df).count() == df.count() and secrets.secret_spans(df.limit(0)).count() == 0


# ---- winnowing
def naive_winnow(text, k, w):
    h = winnowing._gram_hashes(winnowing.np.array([ord(c) for c in text], winnowing.np.uint32), min(k, len(text))).tolist()
    out = []
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1] != at:
            out.append(at)
    return [h[i] for i in out], out


@pytest.mark.parametrize("k, w", [(16, 16), (16, 64), (5, 7), (1, 1)])
def test_winnowing_equals_windows_one_by_one(k, w):
    r = random.Random(k)
    for n in (1, 4, 15, 16, 17, 79, 80, 500):
        t = "".join(r.choice("abé") for _ in range(n))
        got = winnowing.winnow(t, k, w)
        assert (got[0].tolist(), got[1].tolist()) == naive_winnow(t, k, w)


def test_common_passages_share_a_fingerprint():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = word(winnowing.K + winnowing.WINDOW - 1)
        a, b = (set(winnowing.winnow(word(r.randint(0, 300)) + shared + word(r.randint(0, 300)))[0].tolist()) for _ in "ab")
        assert a & b


def test_short_edited_texts_stay_near_and_long_ones_are_winnowed_whole():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    near = [winnowing.likeness(winnowing.winnow(a)[0], winnowing.winnow(winnowing.edited(a, word(n)))[0]) for n in range(60, 130) for a in [word(n)]]
    assert min(near) > 0 and sum(near) / len(near) > 0.3
    long = word(400_000)
    at = winnowing.winnow(long)[1]
    assert at[-1] >= len(long) - winnowing.K - winnowing.WINDOW and max(winnowing.np.diff(at)) <= winnowing.WINDOW


def test_neighbours_follow_descending_ids(spark):
    texts = {5: "e" * 90, 3: "c" * 30, 9: "", 1: None, None: "nul" * 40}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    order = [9, 5, 3, 1, None]
    rows = {r.doc_id: r for r in winnowing.winnowed_pairs(df).collect()}
    assert set(rows) == set(order)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        new = winnowing.edited(texts[a] or "", texts[b] or "")
        assert rows[a].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and rows[a].n_chars == len(texts[a] or "")
        own, changed, following = (set(naive_winnow(s, winnowing.K, winnowing.WINDOW)[0]) if s else set() for s in (texts[a] or "", new, texts[b] or ""))
        for got, other in ((rows[a].near_edited, changed), (rows[a].near_next, following)):
            assert got == (len(own & other) / len(own | other) if own | other else 1.0)
    assert winnowing.winnowed_pairs(df.limit(0)).count() == 0
    one = winnowing.winnowed_pairs(df.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_long_texts_are_winnowed_in_batches_of_bounded_bytes(spark):
    # 200 texts of 300 000 characters: one batch by rows, many by bytes, on the way to a worker and back.
    rows = spark.range(200).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 300000 div length(concat('word ', id, ' '))) AS text").coalesce(1)
    winnowing.winnowed_pairs(rows)

    def sizes(batches):
        for b in batches:
            yield winnowing.pa.RecordBatch.from_arrays([winnowing.pa.array([b.num_rows]), winnowing.pa.array([b.nbytes])], ["n", "bytes"])

    got = rows.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(x.n for x in got) == 200 and max(x.bytes for x in got) <= 2 * winnowing.BATCH_BYTES
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefgh ", k=300_000)) for _ in range(60)]
    whole = winnowing.pa.RecordBatch.from_pydict({"part": [0] * 60, "doc_id": list(range(60, 0, -1)), "text": texts})
    out = list(winnowing._pairs(iter([whole])))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(60, 1, -1))
    assert len(out) > 1 and max(b.nbytes for b in out) <= 2 * winnowing.OUT_CHARS
    assert [f for b in out for f in b.column("fingerprint").to_pylist()] == [winnowing.as_string(winnowing.winnow(t)) for t in texts[:-1]]


# ---- BPE
@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.parsed(bpe.tokenizer_text())


def test_ids_equal_the_library(vocabulary, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    texts = [t or "" for t in AWKWARD] + ["".join(r.choice(["the", " the", "Über", "  ", "\n", "'s", "'ll", "12", "\x1c", "　", "!!", "qzx", "é", "<|endoftext|>", "\x85", "a" * 30]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    lexicon = bpe.Transducer.build((c.encode(), i) for c, i in zip(["the", " the", " there"], vocabulary.encode_chunks(["the", " the", " there"]), strict=True))
    for lex, cached in ((None, 400_000), (lexicon, 400_000), (lexicon, 300)):  # the last forgets and learns again and again
        monkeypatch.setattr(bpe, "CACHED", cached)
        e = bpe.Encoder(vocabulary, lex)
        got = list(e.encode(texts)) if cached > 300 else [x for t in texts for x in e.encode([t])]
        assert [list(x) for x in got] == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
        assert [e.decode(x) for x in got] == texts


def test_long_pieces_equal_the_library_in_little_time(vocabulary):
    import time

    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(8)
    texts = ["".join(r.choices(abc, k=n)) for abc in ("ab", "abcdefghijklmnopqrstuvwxyz", "日本語テキスト処理", "=", "é") for n in (100, 255, 256, 257, 600, 5000)] + ["the" * 30_000, "x" * 70_000]
    began = time.time()
    got = [list(x) for x in bpe.Encoder(vocabulary).encode(texts)]
    assert time.time() - began < 30
    assert got == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    e = bpe.Encoder(vocabulary)
    assert len(list(e.encode(["a" * 1000 + " b"]))) == 1 and set(e.known) - set(vocabulary.added) == {" b"}  # long chunks are not held


def test_transducer_is_minimal_and_exact(tmp_path):
    words = sorted({w + s for w in ("walk", "talk", "stalk", "chalk") for s in ("", "s", "ed", "ing")})
    t = bpe.Transducer.build((w.encode(), [i, i + 1]) for i, w in enumerate(words))
    (tmp_path / "x").write_bytes(t.to_bytes())
    t = bpe.Transducer.mapped(str(tmp_path / "x"))
    assert t.look_up([w.encode() for w in words]) == [[i, i + 1] for i in range(len(words))]
    assert t.look_up([b"", b"wal", b"walkedx", b"zz"]) == [None] * 4
    assert len(t.final) < 20  # suffixes are shared
    assert bpe.Transducer.build([]).look_up([b"a"]) == [None]


def test_encoding_rows(spark, vocabulary):
    df = frame(spark, [*AWKWARD, *AWKWARD])
    rows = {r.doc_id: r for r in bpe.encoded_digests(df).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()}
    e = bpe.Encoder(vocabulary)
    for i, t in enumerate([*AWKWARD, *AWKWARD]):
        assert ids[i] == list(next(e.encode([t or ""]))) and rows[i].n_tokens == len(ids[i])
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoded_digests(df.limit(0)).count() == 0


# ---- chat
def test_chat_round_trip(spark):
    said = [*AWKWARD, "<|im_end|>\n<|im_start|>user\nx", "\\<|im_end|>\\", "<s>[INST]<<SYS>>"]
    rows = [(i // 3, i % 3, ["user", "assistant", None, "sys\ntem", "<s>"][i % 5], t) for i, t in enumerate(said)] + [(None, None, "assistant", "q")]
    df = chat.planted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by: dict = {}
    for c, t, r, x in sorted([*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], key=lambda x: (x[0] or 0, x[1] or 0)):
        by.setdefault(c, []).append((r or "", x or ""))
    for r in chat.formatted(df).collect():
        assert chat.parse(r.text) == by[r.conv_id]
        assert "".join(chat.unescape(r.text.encode()[s.start : s.end].decode()) for s in r.loss) == "".join(x for a, x in by[r.conv_id] if a == "assistant")
    digests = {r.conv_id: r for r in chat.formatted_digests(df).collect()}
    assert digests[-7].n_turns == 2 and digests[-7].loss_chars == 21 and len(digests) == len(by)
    assert chat.formatted_digests(df.limit(0)).count() == 0


def test_conversations_over_many_batches(spark):
    rows = [(1, 0, "user", "hi")] + [(2, i, ["user", "assistant"][i % 2], f"turn {i} </s>") for i in range(13_000)] + [(c, i, "assistant", f"{c}-{i}") for c in range(3, 1500) for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", chat.F.lit(1)).withColumn("n_turns", chat.F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.formatted_digests(df).collect()}
    assert len(got) == 1499 and got[2].n_turns == 13_000 and all(got[c].n_turns == 3 for c in range(3, 1500))
    said = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 2)
    assert got[2].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256("".join(t for c, _, r, t in rows if c == 2 and r == "assistant").encode()).hexdigest()


# ---- html
def test_extraction_leaves_boilerplate_out():
    page = """<html><body><nav><a href=/>Home</a></nav><div class="top-banner">Buy</div><div id=main class="post-42 content"><h1>T&eacute;st</h1>
    <p>One, two <b>th</b>ree<br>four &amp; five &lt;b&gt;<p>six, seven, eight<script>var x = "</p>";</script>
    <aside>side</aside><form><input value=1>ask</form><div class="comment-list"><p>I disagree, strongly, with all of this</p></div><table><tr><td>cell<td>next</table><ul><li>a<li>b</ul></div>
    <div class=cookie-notice>cookies</div><footer>(c)</footer></body></html>"""
    assert html.extract(page, None) == "Tést One, two three four & five <b> six, seven, eight cell next a b"
    assert html.vote(page)[0].endswith(">div.content.post") and html.extract("", None) == "" and html.extract(None, "x") == ""
    assert html.extract("plain words", None) == "plain words" and html.extract("<p>cut off <b>he", ">html") == "cut off he"


def test_host_consensus(spark):
    good = "<div class='story-{}'><p>" + "Long text, with commas, and more text. " * 5 + "</p></div><div class=other><p>{}</p></div>"
    rows = [(i, "http://h.example/x", good.format(i, "short")) for i in range(5)] + [(9, "http://h.example/y", "<div class='story-9'><p>brief</p></div><div class=other><p>" + "noise, " * 60 + "</p></div>"), (10, None, None)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief" and got[10] == "" and got[0].startswith("Long text")


def planted_pages(r):
    """(url, html, main text) of pages from several templates, with boilerplate that is sometimes longer than the article."""
    word = lambda: "".join(r.choices("abcdefghijklmno", k=r.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    links = lambda n: "".join(f"<li><a href=/{word()}>{line(2)}</a></li>" for _ in range(n))
    for host, (open_, close) in {
        "a.example": ("<div class='post-{} entry'>", "</div>"), "b.example": ("<article>", "</article>"), "c.example": ("<main><section class=story>", "</section></main>"), "d.example": ("<td id=text class='x{}'>", "</td>"),
    }.items():
        for k in range(25):
            parts = [f"{line(r.randint(8, 30))}, {line(5)} &amp; {line(3)}." for _ in range(r.randint(1, 6))]
            inside = "".join(f"<p>{p}</p><script>var {word()} = '{line(9)}';</script><div class='ad banner'>{line(6)}</div>" for p in parts)
            around = (f"<table><tr>{open_.format(k)}", f"{close}</table>") if "td" in open_ else (open_.format(k), close)
            body = f"<header>{line(9)}</header><nav><ul>{links(9)}</ul></nav><div class=sidebar>{line(r.randint(5, 200))}</div>{around[0]}{inside}{around[1]}<div class=comments><p>{line(60)}, {line(60)}</p></div><form>{line(9)}</form><footer>{line(20)}</footer>"
            yield f"http://{host}/{k}", f"<html><head><title>{line(3)}</title><style>p {{}}</style></head><body>{body}</body></html>", " ".join(parts).replace("&amp;", "&")


@pytest.mark.parametrize("most", [32_000_000, 0])
def test_planted_articles_are_extracted_alone(spark, monkeypatch, most):
    monkeypatch.setattr(html, "BROADCAST_CHARS", most)  # without it hosts are dealt with salt
    pages = list(planted_pages(random.Random(31)))
    df = spark.createDataFrame([(i, u, h, "x", 0) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string, text string, path long")
    got = {x.page_id: x for x in html.main_text(df).collect()}
    assert len(got) == 100 and all(got[i].text == want and got[i].n_chars == len(want) for i, (_, _, want) in enumerate(pages))
    assert html.main_text(df.limit(0)).count() == 0


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    began = time.time()
    for page in ("<div>" * 60_000 + "core text, and more" + "</div>" * 60_000, "<b>" * 60_000 + "core text, and more" + "</i>" * 60_000, "<div><p>" * 30_000 + "core text, and more", "<span><li>" * 20_000 + "core text, and more"):
        assert html.extract(page, None) == "core text, and more"
        html.vote(page)
    deep = "<div class=a>" * 20_000 + "core text, and more"
    assert html.extract(deep, html.vote(deep)[0]) == "core text, and more"
    assert len(html.extract("<p>some words, and more</p>" * 50_000, None)) == 50_000 * 21 - 1
    assert time.time() - began < 60


# ---- language
def test_language_of_held_out_rows(spark):
    r = random.Random(4)
    words = {"en": ["the", "shing", "tion", "wh"], "de": ["sch", "ung", "über", "keit"], "fr": ["eau", "ç", "tion", "ou"]}
    rows = [(i, " ".join("".join(r.choices(words[x], k=2)) for _ in range(40)), x, "s", 0) for i in range(300) for x in [r.choice(list(words))]]
    rows += [(1000, None, "en", None, None), (1001, "12 34 !", "en", "s", 7), (1002, "", None, "s", 0), (1003, "the shing " * 90000, None, "s", 0)]
    got = {x.doc_id: x for x in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    held = [x for x in rows[:300] if got[x[0]].held_out]
    assert 30 < len(held) < 90 and sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "en"
    assert all(0 <= x.score <= 1 for x in got.values())
    none = language.identify(frame(spark, ["a b"]).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert [x.lang_pred for x in none.collect()] == ["und"]


def test_rare_languages_are_learned_and_slices_lose_nothing(spark, monkeypatch):
    r = random.Random(14)
    words = {"en": ["the", "shing", "tion", "wh"], "de": ["sch", "ung", "über", "keit"], "xx": ["qvo", "zzi", "kju", "vva"]}
    some = lambda x: " ".join("".join(r.choices(words[x], k=2)) for _ in range(30))
    rows = [(i, some(x), x) for i in range(1200) for x in ["xx" if i % 100 == 7 else "en" if i % 10 else "de"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.sample_of(df, 60)
    by = {x: sum(lang == x for _, lang in sample) for x in words}
    assert by["en"] == 60 and by["de"] == 60 and by["xx"] >= 8
    model = language.train(sample)
    texts = [some(x) + " 12, " + some(y) for x in words for y in words]
    assert all(model.predict(some("xx"))[0] == "xx" for _ in range(20))
    whole = [model.logits(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(language, "SLICE", size)
        assert all(language.np.allclose(model.logits(t), z) for t, z in zip(texts, whole, strict=True))
    assert language.identify(df.limit(0)).count() == 0
    clashing = df.withColumn("score", language.F.lit("x")).withColumn("h", language.F.lit(1)).withColumn("there_", language.F.lit(2))
    assert language.identify(clashing).count() == 1200


# ---- n-gram join
def naive_sets(texts, n):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def naive_components(sets, num, den):
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("leaf", [400, 3])
@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100)])
def test_join_equals_all_pairs(spark, n, num, den, leaf, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    if leaf < 400:  # large groups: tokens that stay in their task, ranges of tokens, tables joined by shuffles
        for name, value in (("LOCAL", 2), ("PACK", 500), ("RANGE", 300), ("SMALL", 0)):
            monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(n)
    base = [[r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.choice([3, 5, 8, 20, 60, 200]))] for _ in range(25)]
    texts = [*AWKWARD, "A b  C", "a B\tc"]
    for b in base:
        for _ in range(r.randint(1, 6)):
            c = list(b)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(len(c))] = r.choice("qrstu")
            texts.append(" ".join(c + ["tail"] * r.randint(0, 2)))
    sets = naive_sets(texts, n)
    want = naive_components(sets, num, den)
    got = {x.doc_id: x for x in ngram_join.similar_groups(frame(spark, texts), n, num, den).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    if (leaf, n) in ((400, 4), (3, 5)):
        kept = {x.doc_id for x in ngram_join.distinct_documents(frame(spark, texts), n, num, den).collect()}
        assert kept == {i for i, w in enumerate(want) if i == w}
    else:
        links, members = ngram_join.similar_pairs(frame(spark, texts), n, num, den)
        own = {x.doc_id: x.id for x in members.collect()}
        first = {i: min(j for j, t in enumerate(sets) if t == s) for i, s in enumerate(sets) if s}
        assert own == first
        linked = {(i, j) for i in set(first.values()) for j in set(first.values()) if i > j and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
        assert linked and sorted(map(tuple, links.collect())) == sorted(linked)


def test_components_of_chains_stars_and_later_edges(spark):
    from whence.llm.components import components, joined_further

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 140)] + [(300, 200), (200, 250)]
    edges = spark.createDataFrame(chain, "a long, b long")
    roots = components(edges, "a", "b")
    got = {r.node: r.root for r in roots.collect()}
    assert len(got) == 40 + 40 + 3 and {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 140)} == {100} and got[300] == got[250] == 200
    more = joined_further(roots, spark.createDataFrame([(40, 139), (7, 9), (500, 300)], "a long, b long"), "a", "b")
    got = {r.node: r.root for r in more.collect()}
    assert len(got) == 84 and got[120] == got[3] == 1 and got[500] == got[250] == 200
    assert components(edges.limit(0), "a", "b").count() == 0


def test_rtree_finds_all_that_the_bound_allows():
    np = ngram_join.np
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (150, 64)).astype(np.int32)
    points[50:100] = np.maximum(points[:50] - (rng.random((50, 64)) < 0.1), 0)
    sizes, labels = points.sum(1), rng.integers(0, 40, 150)
    i, j, _ = ngram_join.RTree(points, sizes, labels).pairs(85, 100)
    want = {(x, y) for x in range(150) for y in range(x) if labels[x] != labels[y] and ngram_join.allowed(points[x], points[y], 85, 100)}
    assert want and {(max(p), min(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} >= want
    ids = np.arange(150)
    every, left = ngram_join.candidates(ids, labels, sizes, list(points), 85, 100, False)
    some, _ = ngram_join.candidates(ids, labels, sizes, list(points), 85, 100, True)
    assert set(every) >= want and not left and set(some) <= set(every) and len(some) < 40


def test_folded_points_never_hide_a_link():
    np = ngram_join.np
    rng = np.random.default_rng(5)
    for n in (3, 60, 100, 129, 600, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for share in (0.99, 0.93, 0.9):
            b = np.concatenate([a[: int(share * n)], np.unique(rng.integers(0, 1 << 62, n - int(share * n)).astype(np.uint64))])
            both = len(np.intersect1d(a, b))
            p, q = ngram_join.point(a), ngram_join.point(b)
            assert np.array_equal(ngram_join.unpacked(ngram_join.packed(p)), p) and ngram_join.unpacked(ngram_join.packed(p + 300)).tolist() == (p + 300).tolist()
            assert 100 * both < 80 * (len(a) + len(b) - both) or ngram_join.allowed(p, q, 80, 100)
        other = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert n < 60 or not ngram_join.allowed(ngram_join.point(a), ngram_join.point(other), 80, 100)


def test_extra_columns_that_clash_change_nothing(spark):
    names = ("id", "mark", "n", "digest", "point", "tokens", "label", "hub", "bucket", "ids", "part", "extra", "positions", "set_id", "size", "root")
    plain = frame(spark, [*AWKWARD, "some more words in a row", "some more words in a row"])
    more = plain.select("*", *[ngram_join.F.lit("x").alias(n) for n in names])
    for f in (ngram_join.similar_groups, ngram_join.distinct_documents, winnowing.winnowed_pairs, winnowing.fingerprints, bpe.encoded_digests, bpe.encode_documents, secrets.secret_digests, quality.quality, quality.cleaned):
        assert sorted(map(str, f(more).collect())) == sorted(map(str, f(plain).collect()))


def test_join_on_odd_tables(spark):
    assert ngram_join.similar_groups(frame(spark, [])).count() == 0 and ngram_join.distinct_documents(frame(spark, [])).count() == 0
    repeated = spark.createDataFrame([(1, "one two three four", "en", "s", 1)] * 3 + [(1, "five six seven eight", "en", "s", 1), (2, "five six seven eight", "en", "s", 1)], DOCS)
    assert sorted((x.doc_id, x.text[:4]) for x in ngram_join.distinct_documents(repeated).collect()) == [(1, "five"), (1, "one ")]
    long = " ".join(f"w{i}" for i in range(60_000))
    got = {x.doc_id: x for x in ngram_join.similar_groups(frame(spark, [long, long + " more", "w1 w2 w3 w4"])).collect()}
    assert got[1].component_id == 0 and got[2].component_id == 2 and got[0].n_shingles == 59_997
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (1, "v w x y z", "en", "s", 9), (2, "v w x y z", "en", "s", 9), (None, "a b c d e", "en", "s", 9), (3, None, None, None, None)]
    got = sorted((x.doc_id or -1, x.component_id or -1) for x in ngram_join.similar_groups(spark.createDataFrame(rows, DOCS)).collect())
    assert len(got) == 6 and (2, 1) in got and (3, 3) in got


# ---- quality, mixing, sharding
def naive_quality(t):
    w = WORD.findall(t or "")
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_equal_loops(spark):
    r = random.Random(8)
    texts = [*AWKWARD] + [" ".join(r.choice(["a", "b", "c#", "é|", "\n", "line\nline"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    got = {x.doc_id: x for x in quality.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        want = naive_quality(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not x.base_failed or not x.kept)


def normal(line):
    return " ".join(WORD.findall(line)).lower()


def naive_over(rows):
    """(source, normalised line) of the lines above their host's limit, for rows of (doc_id, text, lang, source, n_chars)."""
    docs, texts, hosts = {}, {}, {}
    for i, t, _, s, _ in rows:
        hosts.setdefault(s, set()).add(i)
        for x in (t or "").split("\n"):
            if WORD.search(x):
                docs.setdefault((s, normal(x)), set()).add(i)
                texts.setdefault((s, normal(x)), set()).add(t)
    return {k for k, v in docs.items() if len(v) >= quality.LEAST_DOCS <= len(texts[k]) and (len(v) >= quality.MOST_DOCS or len(v) >= quality.SHARE * len(hosts[k[0]]))}


def naive_judged(rows):
    """removed_words and kept of each row, by loops."""
    over, out = naive_over(rows), []
    for _, t, _, s, _ in rows:
        own = [normal(x) for x in (t or "").split("\n") if WORD.search(x)]
        n, removed, m = len(WORD.findall(t or "")), sum(len(x.split(" ")) for x in own if (s, x) in over), naive_quality(t)
        failed = n < 20 or 100 * m[4] > 30 * n
        out.append((removed, not failed and not (removed and (n - removed < quality.LEAST_WORDS or n - removed < quality.LEAST_PART * n))))
    return out


def naive_cleaned(rows):
    """The text of each row that is kept, without lines above the limit, by number of the row."""
    over = naive_over(rows)
    return {k: "\n".join(x for x in t.split("\n") if (s, normal(x)) not in over) for k, ((_, t, _, s, _), (_, kept)) in enumerate(zip(rows, naive_judged(rows), strict=True)) if kept}


def test_frequent_lines_are_removed_and_depleted_documents_go(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    notice = " ".join(f"legal{j}" for j in range(25))
    texts = [own(i) for i in range(100)] + [f"{own(1000 + i)}\n{notice.upper()}" for i in range(40)] + [notice] + [own(7)] * 50
    rows = [(i, t, "en", "host", len(t)) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "host", 1)] * 3 + [(5000, f"{own(1)}\n{own(5000)}", "en", "host", 1)] * 30  # ids that repeat count once
    rows += [(None, None, None, None, None), (6000, "", "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("host", quality.F.lit(1)).withColumn("mark", quality.F.lit(2)).withColumn("kept", quality.F.lit(3))
    got = {x.doc_id: x for x in quality.quality(df).collect()}
    assert not got[140].kept and not got[140].base_failed and all(got[i].kept for i in range(140)) and got[100].removed_words == 25
    assert all(got[i].kept for i in range(141, 191)) and got[5000].removed_words == 0  # copies alone do not make a line frequent
    clean = {x.doc_id: x for x in quality.cleaned(df).collect()}
    assert clean[100].text == own(1000) and clean[100].n_chars == len(own(1000)) and 140 not in clean and len(clean) == 191
    assert quality.quality(df.limit(0)).count() == 0 and quality.cleaned(df.limit(0)).count() == 0
    assert [(got[i].removed_words, got[i].kept) for i, *_ in rows[:190]] == naive_judged(rows)[:190]


def test_line_limits_equal_loops_in_any_host(spark, monkeypatch):
    r = random.Random(21)
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    shared = [" ".join(f"s{k}y{j}" for j in range(r.randint(1, 40))) for k in range(12)]
    rows = []
    for i in range(900):
        host = "big" if i < 600 else f"h{i % 7}"
        parts = [own(r.randrange(i + 1))] * r.choice([1, 1, 0]) + [x.upper() if r.random() < 0.3 else x for k, x in enumerate(shared) if r.random() < 0.5 / (k + 1)]
        rows.append((r.randrange(i + 1) if r.random() < 0.1 else 1000 + i, "\n".join(parts), "en", host, 0))
    df = spark.createDataFrame([(*x[:4], k) for k, x in enumerate(rows)], DOCS)
    for most_docs in (quality.MOST_DOCS, 30):
        monkeypatch.setattr(quality, "MOST_DOCS", most_docs)
        want = naive_judged(rows)
        assert 0 < sum(x > 0 for x, _ in want) < 900 and not all(ok for _, ok in want)
        for most in (500_000, 0):  # broadcast, and joined with salt
            monkeypatch.setattr(quality, "BROADCAST_LINES", most)
            got = {x.n_chars: (x.removed_words, x.kept) for x in quality.judged(quality.measured(df, ("n_chars",)), most_docs=most_docs).collect()}
            assert [got[k] for k in range(900)] == want


def test_targets_and_routes():
    assert targets_of([10, 100, 5, 20], [5, 2, 1, 5], 3) == [30, 30, 15, 60]
    assert targets_of([], [], 3) == [] and targets_of([0, 0], [5, 2], 3) == [0, 0]
    flows = route([(10, {0: 10}), (20, {0: 20, 1: 20}), (0, {1: 0})], [40, 20], 3)
    assert flows[0][0] + flows[1][0] == 40 and flows[1][1] == 20 and route([], [], 3) == []


def test_routes_cost_least_of_all_flows():
    from itertools import product

    r = random.Random(13)

    def price(flow, words, steps):  # of `flow` words, whose passes hold `words` each at first
        out, k = 0, 0
        while flow > 0:
            part = min(flow, words << max(0, k - steps + 1))
            out, flow, k = out + k * part, flow - part, k + 1
        return out

    for _ in range(60):
        repeats, m = r.choice([1, 2, 3]), 2
        patterns = []
        for held in ([0], [1], [0, 1]):
            rows = {j: r.randint(0, 3) for j in held}
            patterns.append((r.randint(max(rows.values()) if len(held) > 1 else (sum(rows.values()) + 1) // 2, sum(rows.values())), rows))
        patterns, quotas = r.sample(patterns, r.choice([2, 3])), [r.randint(0, 12) for _ in range(m)]
        arcs = [(i, j, repeats * w) for i, (_, held) in enumerate(patterns) for j, w in held.items()]

        def cost(flow):  # (words short, price), or None if a quota is passed
            if any(sum(f for f, (_, j, _) in zip(flow, arcs, strict=True) if j == k) > quotas[k] for k in range(m)):  # noqa: B023
                return None
            total = sum(price(f, patterns[i][1][j], 99) for f, (i, j, _) in zip(flow, arcs, strict=True) if f)  # noqa: B023
            for i, (words, _) in enumerate(patterns):  # noqa: B023
                through = sum(f for f, (k, _, _) in zip(flow, arcs, strict=True) if k == i)  # noqa: B023
                total += price(through, words, repeats) if through else 0  # noqa: B023
            return -sum(flow), total

        best = min(c for f in product(*[range(min(c, quotas[j]) + 1) for _, j, c in arcs]) if (c := cost(f)) is not None)
        flows = route(patterns, quotas, repeats)
        assert cost([flows[i][j] for i, j, _ in arcs]) == best


def test_mixing_comes_near_its_targets(spark):
    from whence.llm import mixing

    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)) if i % 3 else f"same {i % 40}", None, r.choice(["a", "b", None, "c", "c", "c"]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", mixing.F.lit(1)).withColumn("pattern", mixing.F.lit("x"))
    got = mixing.mix(df, extra=("source",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, extra=("source",)).collect()))
    assert any("," in x.pattern for x in got) and len(got) == 900
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goals = dict(zip(("a", "b", "c", None), targets_of([sizes[s] for s in ("a", "b", "c", None)], [5, 2, 1, 5], 3), strict=True))
    by: dict = {}
    for x in got:
        assert x.taken <= 3 * x.size and x.taken == x.passes * x.size and x.target == goals[x.source] and x.source_size == sizes[x.source]
        by[x.source] = by.get(x.source, 0) + x.taken
    assert all(abs(by[s] - goal) <= max(10, 0.01 * goal) for s, goal in goals.items())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_with_given_sources_loses_no_row(spark):
    from whence.llm import mixing

    held = [["x"], [], None, ["x", "y"], [None], ["y", "x", "x"], ["z", None]]
    rows = [(i, " ".join(["w"] * (1 + i % 9)), h) for i, h in enumerate(held * 20)] + [(None, None, ["x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    got = mixing.mix(df, sources=mixing.F.col("held")).collect()
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == list(range(140)) and len(got) == 141
    assert len({x.pattern for x in got}) == 4 and all(x.passes <= 3 for x in got)
    quota: dict = {}
    for x in got:
        quota.setdefault(x.pattern, [0, x.target])[0] += x.taken
    assert sum(t for t, _ in quota.values()) > 0 and all(t <= 1.01 * goal for t, goal in quota.values())


def test_all_patterns_of_any_number_of_sources_meet_in_the_flow(spark):
    from whence.llm import mixing

    # 1540 texts that two of 56 sources hold each, two texts that all hold, and one text of each source's own.
    names = [f"s{i:02}" for i in range(56)] + [f"u{i:02}" for i in range(14)]
    texts = [(f"pair {a} {b} " * (1 + a % 3), (names[a], names[b])) for b in range(56) for a in range(b)]
    texts += [("for all of them " * 5, names), ("and once more " * 4, names)] + [(f"own {n} " * 30, (n,)) for n in names]
    rows = [(i, t, None, s, 0) for i, (t, s) in enumerate((t, s) for t, held in texts for s in held)]
    got = {x.doc_id: x for x in mixing.mix(spark.createDataFrame(rows, DOCS), extra=("source",)).collect()}
    holders = {t: sorted("s" + s for s in held) for t, held in texts}
    assert len(got) == len(rows) and all(json.loads(got[i].pattern) == holders[t] for i, t, *_ in rows)
    by: dict = {}
    for x in got.values():
        assert x.taken == x.passes * x.size and x.passes <= 3
        by.setdefault(x.source, [0, x.target])[0] += x.taken
    assert all(abs(taken - goal) <= max(20, 0.01 * goal) for taken, goal in by.values())
    narrow = mixing.mix(spark.createDataFrame(rows, DOCS), extra=("source",), named=False)
    assert "pattern" not in narrow.columns and {x.doc_id: x.taken for x in narrow.collect()} == {i: x.taken for i, x in got.items()}


def test_groups_beyond_a_broadcast_give_the_same_mix(spark, monkeypatch):
    from whence.llm import mixing

    rows = [(i, f"text {i % 90} " * (1 + i % 5), None, "abcd"[i % 4 if i % 3 else i // 90 % 4], 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    plain = sorted(map(str, mixing.mix(df, extra=("source",)).collect()))
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(str, mixing.mix(df, extra=("source",)).collect())) == plain


def test_rare_patterns_count_as_their_own_source(spark, monkeypatch):
    from whence.llm import mixing

    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    monkeypatch.setattr(mixing, "SMALL", 0)
    rows = [(i, f"text {i % 30} " * 9, None, "abc"[i % 2 + (i % 30) % 2], 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), extra=("source",)).collect()
    assert len(got) == 300 and sum("," in x.pattern for x in got) <= 300 and sum(x.taken for x in got) > 0


def test_hilbert_curve_moves_one_step_at_a_time():
    for bits, dims in ((4, 3), (3, 2), (2, 4)):
        at = {h: p for p, h in enumerate(hilbert_indices(bits, dims))}
        assert sorted(at) == list(range(1 << bits * dims))
        unpack = lambda p: [(p >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)]  # noqa: E731, B023
        assert all(sum(abs(a - b) for a, b in zip(unpack(at[i]), unpack(at[i + 1]), strict=True)) == 1 for i in range(len(at) - 1))


def test_shards_equal_a_sort_by_curve(spark):
    import zlib

    from whence.llm import sharding

    F = sharding.F
    rows = [(i % 97, "x" * (i * 7 % 300), None if i % 5 == 0 else ["de", "en", "fr"][i % 3], None if i % 7 == 0 else f"s{i % 30}", 0) for i in range(700)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    salts = df.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("c")).distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", "c"), F.lit(sharding.LEAST_SALTS)))
    salt = {(x.doc_id, x.c): x.salt for x in salts.collect()}
    top = max(len(t or "") for _, t, *_ in rows) + 9.0
    curve = hilbert_indices(4, 3)

    def code(s, low, high):
        if s is None:
            return 0
        n = sharding._common(low, high)
        unit = lambda v: (ord(v[n]) if len(v) > n else 0) * 256 + (ord(v[n + 1]) if len(v) > n + 1 else 0)
        return max(0, min(15, int((unit(s) - unit(low)) * 16 // (unit(high) - unit(low) + 1))))

    import math

    sources, langs = sorted({x[3] for x in rows if x[3]}), sorted({x[2] for x in rows if x[2]})
    order = []
    for i, t, lang, source, _ in rows:
        size, crc = len(t or "") + 8, zlib.crc32((t or "").encode())
        at = (code(source, sources[0], sources[-1]) * 16 + code(lang, langs[0], langs[-1])) * 16 + min(15, int(math.log2(size) * 16 / math.log2(top)))
        order.append((curve[at], salt[i, crc], -1 if i is None else i, crc, size))
    order.sort()
    want = [((k * 24) // 701, *x[2:]) for k, x in enumerate(order)]
    got = sharding.hilbert_shards(df, 24).collect()
    assert sorted((x.shard, -1 if x.doc_id is None else x.doc_id, x.text_crc32, x.size) for x in got) == sorted(want)
    firsts = [min(k for k in range(701) if k * 24 // 701 == s) for s in range(24)]
    assert sorted((firsts[x.shard] + x.slot, -1 if x.doc_id is None else x.doc_id, x.text_crc32) for x in got) == [(k, x[2], x[3]) for k, x in enumerate(order)]


def test_shards_are_even_and_gapless(spark):
    from whence.llm import sharding

    rows = [(i % 37, "x" * (i % 50), None if i % 5 == 0 else "de", None if i % 7 == 0 else f"s{i % 3}", 0) for i in range(500)] + [(None, None, None, None, None)]
    got = sharding.hilbert_shards(spark.createDataFrame(rows, DOCS).withColumn("shard", sharding.F.lit(1)), 24).collect()
    counts: dict = {}
    for x in got:
        counts.setdefault(x.shard, []).append(x.slot)
    assert len(got) == 501 and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1 and set(counts) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sharding.hilbert_shards(spark.createDataFrame([], DOCS)).count() == 0
