"""The operators for training text, on small tables with every odd case, against brute force."""

import base64
import collections
import contextlib
import hashlib
import io
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from tideframe.llm import byte_bpe, cotraining, exact_dedup, jaccard_join, language_id, mixing, quality_rules, surrogates, token_counts, url_filter

BPE, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 20000
ODD = ["  a", "a  b", "\n a", " ", "", None, "a\x00b", "x▁y", "　z", "a \n\n  b  ", "it's we'll 'S", "日本語 テスト x", "🙂🙂 ok", "a" * 2000 + " b", "\x1c \x1d a", "١٢٣ abc123", "<|endoftext|> x", "x \n", LONG]


def table(spark, texts):
    """Rows with columns whose names clash with what operators add."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score double")


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# 1 ---------------------------------------------------------------------------------------------------------------------


def groups_of(rows):
    best, n = {}, collections.Counter()
    for i, t in rows:
        best[t or ""] = max(i, best.get(t or "", i))
        n[t or ""] += 1
    return {i: (best[t or ""], n[t or ""], best[t or ""] == i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, digest):
    texts = [*ODD, "same", "same", "same", "", "other", LONG]
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.exact_dedup(table(spark, texts), digest=digest).collect()}
    assert got == groups_of(list(enumerate(texts)))


def test_exact_dedup_goes_on_from_a_checkpoint(spark, tmp_path):
    docs, state = str(tmp_path / "docs"), str(tmp_path / "state")
    table(spark, ["a", "b"]).write.parquet(docs)
    exact_dedup.exact_dedup_files(spark, docs, checkpoint=state)
    table(spark, ["x", "x", "a"]).write.mode("append").parquet(docs)
    got = exact_dedup.exact_dedup_files(spark, docs, checkpoint=state, files_per_batch=1)
    assert sorted((r["group_size"], r["kept"]) for r in got.collect()) == [(1, True), (2, False), (2, False), (2, True), (2, True)]


def test_exact_dedup_of_nothing_and_drop_copies(spark):
    assert exact_dedup.exact_dedup(table(spark, ["a"]).limit(0)).count() == 0
    out = exact_dedup.drop_copies(table(spark, ["a", "b", "a", None, ""]).unionByName(table(spark, ["a", "b"]).where("doc_id = 1")))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4] and out.columns == table(spark, []).columns


def test_exact_dedup_keeps_one_of_rows_without_id(spark):
    rows = [(None, "same"), (None, "same"), (None, "same"), (None, "x"), (4, "x"), (9, None), (None, "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = collections.Counter((r["text_sha256"], r["keep_id"], r["group_size"]) for r in got if r["kept"])
    assert len(got) == 7 and sorted((k[1] or 0, k[2], n) for k, n in kept.items()) == [(0, 3, 1), (4, 2, 1), (9, 2, 1)]


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    texts = ["Mail bob.smith@corp.example.com or +1 (244) 555-4688. Mr. Smith, Mrs. Smith", "bob.smith@corp.example.com from 81.117.189.12 paid 4111 1111 1111 1111", 'token = "5b99a6ad1541b47c08e07031f8bf3610372d077f"', None, "", "nothing here 12 3.5", "г-жа Иванова", "bob.smith@corp.example.com from 81.117.189.12 paid 4111 1111 1111 1111"]
    got = {r["doc_id"]: r for r in surrogates.replace_entities(table(spark, texts), "k").collect()}
    assert [got[i]["n_entities"] for i in range(8)] == [4, 3, 1, 0, 0, 0, 1, 3]
    assert got[3]["text"] is None and got[5]["text"] == texts[5] and got[1]["text"] == got[7]["text"]
    first, second = got[0]["text"], got[1]["text"]
    mail = re.search(r"[\w.]+@[\w.]+", first).group()
    assert mail in second and "smith" not in first.lower() and re.fullmatch(r"[a-z]{3}\.[a-z]{5}@m\d+\.example\.(com|net|org)\.?", mail)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", first) and "555-4688" not in first
    assert re.search(r"Mr\. \w+on, Mrs\. \w+ina", first)
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", second).group()
    digits = [int(c) for c in card if c.isdigit()][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0 and card != "4111 1111 1111 1111"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[2]["text"]) and got[2]["text"] != texts[2]
    assert surrogates.replace_entities(table(spark, ["a"]).limit(0), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    texts = [f"10.0.{i // 200}.{i % 200} " for i in range(600)]
    out = [r["text"] for r in surrogates.replace_entities(table(spark, texts), "k").collect()]
    assert len(set(out)) == 600 and not set(out) & set(texts)


def test_surrogates_of_other_formats(spark):
    numbers = ["555-123-4567", "+44 20 7946 0958", "+49-30-1234567", "(555) 123-4567", "1-800-555-1234", "+14155550123", "030 1234567", "020 7946 0958", "06 12 34 56 78", "3782 822463 10005", "378282246310005"]
    got = [r["text"] for r in surrogates.replace_entities(table(spark, [f"call {n}, please" for n in numbers]), "k").orderBy("doc_id").collect()]
    for n, text in zip(numbers, got):
        new = re.fullmatch(r"call (.*), please", text).group(1)
        assert new != n and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", n), (n, text)
    plain = ["from 2021-03-15 to 03/2021, 12:30, 1999-2000, v1.2.3, 3.14159, 10 000 000", "The doctor and the professor left. Smith said so."]
    assert [r["text"] for r in surrogates.replace_entities(table(spark, plain), "k").orderBy("doc_id").collect()] == plain


def test_surrogates_share_names_and_addresses(spark):
    texts = ["Mr. John Smith met Dr. Jane van Houten-O'Brien. Smith's aim: John, SMITH and Blacksmith", "Mr Smith", "Mrs. Smith; Smith", "Prof. Dr. J. R. Smith", "Bob@Corp.com bob@corp.com", "г-н Иванов и г-жа Иванова"]
    got = {r["doc_id"]: r for r in surrogates.replace_entities(table(spark, texts), "k").collect()}
    t = [got[i]["text"] for i in range(6)]
    john, smith = re.match(r"Mr\. (\w+on) (\w+on) met Dr\. \w+on van \w+on-\w+on\. ", t[0]).groups()
    assert t[0].endswith(f". {smith}'s aim: {john}, {smith.upper()} and Blacksmith") and got[0]["n_name"] == 5
    assert t[1] == f"Mr {smith}" and t[2] == "Mrs. {0}; {0}".format(smith[:-2] + "ina") and re.fullmatch(rf"Prof\. Dr\. [A-Z]\. [A-Z]\. {smith}", t[3])
    assert len(set(t[4].split())) == 1 and "corp" not in t[4].lower()
    assert re.fullmatch(r"г-н (\w+)ов и г-жа \1ина", t[5])


def test_surrogates_of_very_long_texts(spark):
    texts = ["a" * 300_000, "a." * 100_000 + "@", "x@" * 50_000, "7" * 100_000, "Mr " * 50_000, "1-" * 60_000, "password=" * 20_000]
    t0 = time.time()
    got = surrogates.replace_entities(table(spark, texts), "k").collect()
    assert len(got) == len(texts) and time.time() - t0 < 60


# 3 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sets", [1, 1 << 10])
def test_bpe(spark, sets):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})
    texts = [*ODD, *itertools.islice(texts_of(spark).values(), 40)]
    got = {r["doc_id"]: r for r in byte_bpe.encode(table(spark, texts), BPE, public_tokenizers.PATTERN, sets=sets, with_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert list(got[i]["token_ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_of_very_long_words(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(300_000)), "a" * 20_000, "é" * 200, "z" * 257, "z" * 256, "z" * 256]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})
    rows = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")  # one id for all
    got = byte_bpe.encode(rows, BPE, public_tokenizers.PATTERN, sets=1 << 7, with_ids=True).collect()
    assert sorted(r["token_ids"] for r in got) == sorted(library.encode_ordinary(t) for t in texts)


def test_bpe_of_many_ids(spark, tmp_path):
    """Ids of 2^16 and more don't fit 16 bits, nor do those beside 2^15 with a sign."""
    for top in (1 << 15, (1 << 16) - 1, 1 << 16):
        ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b" ab": top}
        ranks |= {b"\xff" + i.to_bytes(3, "big"): i for i in range(257, top)}  # never met
        file = tmp_path / f"{top}.tiktoken"
        file.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
        got = byte_bpe.encode(table(spark, ["ab ab", "ab", None]), str(file), public_tokenizers.PATTERN, sets=4, with_ids=True)
        assert {r["doc_id"]: list(r["token_ids"]) for r in got.collect()} == {0: [256, top], 1: [256], 2: []}


def test_bpe_leaves_little_to_the_driver(spark, monkeypatch):
    """Held words come as 8 and 16 bits a number, and the optimizer doesn't put a parsed rank map into the plan."""
    sent, staged, broadcast, stage = [], {}, spark.sparkContext.broadcast, byte_bpe.stage
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or broadcast(x))
    monkeypatch.setattr(byte_bpe, "stage", lambda df, name: staged.setdefault(name, df) and stage(df, name))
    byte_bpe.encode(table(spark, ["one two three", *itertools.islice(texts_of(spark).values(), 40)]), BPE, public_tokenizers.PATTERN, sets=1 << 10)
    ((first, n, ids),) = sent
    assert len(n) > 1000 and len(ids) >= len(n) and len(ids) == n.sum()
    assert first.nbytes <= 4 << 10 and n.nbytes == len(n) and ids.nbytes == 2 * len(ids)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        staged["ranks"].explain("extended")
    assert "from_json" in plan.getvalue().split("== Optimized Logical Plan ==")[1]


def test_bpe_of_nothing(spark):
    assert byte_bpe.encode(table(spark, ["a"]).limit(0), BPE, public_tokenizers.PATTERN).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.95


def test_language_sample(spark):
    """All languages, however many; an id that repeats takes no other row's place; equal rows count once."""
    rows = [(8 * i, f"text {i}", f"l{i % 450}") for i in range(900)] + [(1, f"copy of {i}", "de") for i in range(4000)] + [(1, "same", "de")] * 500
    rows += [(i, f"german row {i}", "de") for i in range(2, 300)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = language_id.sample_labelled(docs, 40, "doc_id", "text", "lang")
    count = collections.Counter(labels)
    assert set(labels) == {r[2] for r in rows} and count["de"] == 40
    german = [t[0].decode() for t, l in zip(texts, labels) if l == "de"]
    assert len(set(german)) == 40
    assert language_id.sample_labelled(docs, 10**6, "doc_id", "text", "lang")[1].count("de") <= language_id.ALL_ROWS


def test_language_training_takes_whole_passages(monkeypatch):
    seen = []
    whole = language_id.windows_of
    monkeypatch.setattr(language_id, "windows_of", lambda x: seen.append(len(whole(x))) or whole(x))
    language_id.train([["\u044f".encode() * 256], [b"a" * 256]], ["ru", "en"], steps=1)
    assert seen == [2, 1]  # 512 bytes are two windows


def test_network_is_its_plain_form(spark):
    """Window by window: convolutions of each width, the largest response, one hidden layer, softmax; then the mean."""
    net = language_id.train([[b"der hund und die katze sind hier"], [b"the dog and the cat are over here"]] * 3, ["de", "en"] * 3, steps=20)
    text = "the katze und hund " * 40
    names, scores = language_id.predict(net, net.pair_tables(), [text])
    logs = []
    for w in language_id.windows_of(text.encode()):
        hidden = []
        for width in language_id.WIDTHS:
            f = net.filters[width]
            responses = [sum(f[j][int(w[i + j])] for j in range(width)) for i in range(language_id.WINDOW - width + 1)]
            hidden.append(np.max(responses, axis=0))
        h = np.maximum(np.concatenate(hidden) + net.bias, 0)
        z = h @ net.weights + net.offset
        logs.append(z - np.log(np.exp(z - z.max()).sum()) - z.max())
    p = np.exp(np.mean(logs, axis=0))
    p /= p.sum()
    assert names == [net.languages[int(p.argmax())]] and scores[0] == pytest.approx(p.max(), abs=1e-6)


def test_language_odd_texts(spark):
    got = {r["doc_id"]: r for r in language_id.identify(table(spark, ODD)).collect()}
    letterless = {i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == letterless and all(0 <= r["score"] <= 1 for r in got.values())
    unlabelled = table(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(unlabelled).first()["lang_pred"] == "und"
    assert language_id.identify(table(spark, ["a"]).limit(0)).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.org/x", "https://a.example.org/es/1", "https://example.org/en/12?x", "http://b.com/fr/", "http://b.com/de/#a", "http://com/de/", "http://org", "x://notexample.org/es/"]
    want = [("", "", None), ("", "", None), ("", "", None), ("a.org", "/x", "org/"), ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.com", "/fr/", "com/fr/"), ("b.com", "/de/", "com/de/"), ("com", "/de/", "com/de/"), ("org", "", None), ("notexample.org", "/es/", "org/")]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(urls))] == want


def test_url_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(0, "http://good.org/a", link("near.net")), (1, "http://near.net/", link("far.net")), (2, "http://far.net/", None), (3, "http://bad.com/de/1", None), (4, "http://fan.net/", link("bad.com")), (5, "http://alone.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert [got[i]["verdict"] for i in range(6)] == ["allow", "allow", "allow", "block", "block", "allow"]
    # brute force: power series of the walk from good.org
    d = 0.85
    assert got[1]["trust"] == pytest.approx((1 - d) * d) and got[2]["trust"] == pytest.approx((1 - d) * d * d) and got[4]["distrust"] == pytest.approx((1 - d) * d)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_links_behind_long_attributes(spark):
    """A link counts wherever its href stands in the tag."""
    far = "<a data-x='" + "y" * 3000 + "'" + " " * 40 + "href" + " " * 30 + "=" + " " * 30 + "'" + "h" * 30 + "://example.org/es/1'>x</a>"
    pages = spark.createDataFrame([(1, "http://example.org/es/1", ""), (2, "http://unknown.net/", far), (3, "http://other.net/", "<a>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


# Names and ids that get in the way ------------------------------------------------------------------------------------


def test_columns_with_inner_names_pass(spark):
    rows = [(i, f"text number {i} of some words here", "en", "ab"[i % 2], 1, 7, 8, "x", None) for i in range(20)] + [(None, None, None, None, 1, 7, 8, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _s int, _h int, _id int, _suspect string, _sha string").withColumn("_k", F.lit(1)).withColumn("_T", F.lit(2)).withColumn("_language", F.lit("l"))
    want = sorted(map(str, docs.collect()))
    for out in (mixing.mix(docs).select(*docs.columns), exact_dedup.drop_copies(docs), jaccard_join.drop_near(docs)):
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == want


def test_mixing_tells_all_sources_apart(spark):
    """Each source keeps its own weight, whatever their number."""
    docs = spark.createDataFrame([(i, f"s{i % 3000}") for i in range(6000)], "doc_id long, source string")
    got = mixing.mix(docs, {f"s{i}": 2 if i == 7 else 1 for i in range(3000)}, block_docs=1).collect()
    assert len({(r["mix_slot"], r["mix_offset"]) for r in got}) == 6000
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    assert sorted(r["mix_slot"] for r in got if r["source"] == "s7")[1] < 3001  # two blocks a period of 3,001 slots


def test_mixing_spreads_an_id_with_many_rows_and_keeps_names(spark):
    docs = spark.createDataFrame([(7 if i % 3 == 0 else i, f"t{i}", "a") for i in range(3000)], "doc_id long, text string, source string").withColumn("mix_slot", F.lit("mine"))
    out = mixing.mix(docs, prefix="_mix_")
    assert out.columns[:4] == docs.columns and {r["mix_slot"] for r in out.collect()} == {"mine"}
    assert len({(r["_mix_slot"], r["_mix_offset"]) for r in out.collect()}) == 3000


# 6 ---------------------------------------------------------------------------------------------------------------------


def quality_rows(n, seed=5):
    """(text, quality, source): both views tell the quality most of the time only, and apart from each other."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        q = rng.random() < 0.5
        text = " ".join(rng.choice(words) + ("###" if not q and rng.random() < 0.3 else "") for _ in range(rng.randint(30, 90)))
        rows.append((text + "." if q else text, int(q), ("a" if q else "b") if rng.random() < 0.8 else rng.choice("ab")))
    return rows


def test_cotraining_held_out():
    rows = quality_rows(400)
    x = np.array([cotraining.text_features(t) for t, _, _ in rows])
    m = cotraining.metadata_features(np.array([cotraining.metadata_cells(s, "en", len(t)) for t, _, s in rows]))
    y = np.array([q for _, q, _ in rows], float)
    asked = []

    def most_sure(teacher, model, label, taken):
        odds = model.log_odds({"text": x, "meta": m}[teacher])
        side = [i for i in range(100, 200) if i not in taken and (odds[i] > 2 if label else odds[i] < -2)]
        asked.append(teacher)
        return [(i, x[i], m[i]) for i in sorted(side, key=lambda i: -abs(odds[i]))[:10]]

    model = cotraining.co_train(x[:100], m[:100], y[:100], most_sure, 0.5)
    right = ((model.score(x[200:], m[200:]) >= 0.5) == (y[200:] == 1)).mean()
    by_source = np.mean([(s == "a") == (q == 1) for _, q, s in rows[200:]])
    assert set(asked) == {"text", "meta"} and right > 0.95 > by_source


def test_cotraining_over_a_table_against_numpy(spark):
    rows = quality_rows(300, 6)
    docs = spark.createDataFrame([(i, t, s, "en", len(t)) for i, (t, _, s) in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, q) for i, (_, q, _) in enumerate(rows[:80])] + [(0, rows[0][1])], "doc_id long, quality int")
    x = np.array([cotraining.text_features(t) for t, _, _ in rows])
    m = cotraining.metadata_features(np.array([cotraining.metadata_cells(s, "en", len(t)) for t, _, s in rows]))
    y = np.array([q for _, q, _ in rows], float)
    made = []
    real = cotraining.co_train

    def spy(tx, mx, ty, most_sure, rate):
        def checked(teacher, model, label, taken):
            got = most_sure(teacher, model, label, taken)
            odds = model.log_odds({"text": x, "meta": m}[teacher])
            sure = [i for i in range(80, 300) if i not in taken and (odds[i] > np.log(9) if label else odds[i] < -np.log(9))]
            assert len(got) == min(20, len(sure)) and {g[0] for g in got} <= set(sure)
            return got

        made.append(real(tx, mx, ty, checked, rate))
        return made[0]

    cotraining.co_train = spy
    try:
        got = {r["doc_id"]: r["score"] for r in cotraining.score_quality(docs, labels, per_round=20).collect()}
    finally:
        cotraining.co_train = real
    want = made[0].score(x, m)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(300))
    assert np.mean([(got[i] >= 0.5) == (y[i] == 1) for i in range(80, 300)]) > 0.9


def test_cotraining_odd_tables(spark):
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 7)], "doc_id long, quality int")
    got = cotraining.score_quality(table(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0.5 for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(table(spark, ODD).drop("score").withColumn("n_chars", F.lit(None).cast("long")))
    got = cotraining.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------------


def components_of(rows, words=5, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, n=120):
    """Groups of edited copies around the threshold, a passage many share, and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 90))]
        for _ in range(n // 4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]) for _ in range(n // 4)]
    return texts + ["a b c d e f g h", "a b c d e f g h i", "A b  c", "a b c"]


@pytest.mark.parametrize("seed,bucket,pivots,few", [(1, 24, 3, 4), (2, 1, 1, 0), (4, 2, 1, 0)])
def test_jaccard_components(spark, seed, bucket, pivots, few):
    texts = [*near_copies(seed), *ODD]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, texts), small_bucket=bucket, pivots=pivots, few_pairs=few).collect()}
    assert got == components_of(list(enumerate(texts)))


def test_jaccard_links_and_membership(spark):
    texts = near_copies(5, 60)
    links, member = jaccard_join.jaccard_links(table(spark, texts))
    rep = {r["doc_id"]: r["class_id"] for r in member.collect()}
    sets = {i: {tuple(w[j : j + min(5, len(w))]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in enumerate(texts))}
    want = {(a, b) for a, b in itertools.combinations(sorted(set(rep.values())), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == want != set()
    assert rep == {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}


def test_jaccard_keeps_rows_without_id_and_with_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (None, "no other has this"), (3, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(None, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 1, None), (3, 0, 3)], key=str)


def test_jaccard_of_nothing_and_drop_near(spark):
    assert jaccard_join.jaccard_components(table(spark, ["a"]).limit(0)).count() == 0
    out = jaccard_join.drop_near(table(spark, ["a b c d e f g h i j k", "a b c d e f g h i j", "other text", None]))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


def test_prefix_order_is_rare_first_for_any_count_table(spark):
    texts = near_copies(3, 40)
    one = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(table(spark, texts), cells=1 << 14).collect()}
    assert one == {i: c for i, (_, c) in components_of(list(enumerate(texts))).items()}


# 8 ---------------------------------------------------------------------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    c = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_quality_base_counts(spark):
    texts = [*ODD, "a b c a b c", "x\nx\n\n \ny", "## a | b", *texts_of(spark).values()]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = base_counts(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])


def test_js_distance(spark):
    x = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    assert [r["d"] for r in x.select(quality_rules.js_distance(F.col("p"), F.col("q")).alias("d")).collect()] == [1.0, 0.0]
    assert quality_rules.quality_rules(table(spark, ["a"]).limit(0)).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("slots", [1, 1 << 16])
def test_token_counts(spark, slots):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*ODD, *itertools.islice(texts_of(spark).values(), 60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(table(spark, texts), PIECES, limit=100, slots=slots).collect()}
    n = [len(library.encode(t or "")) for t in texts]
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 100) for i, t in enumerate(texts)}


def test_token_counts_of_repeated_ids_and_nothing(spark):
    twice = table(spark, ["a b"]).unionByName(table(spark, ["a b"]))
    assert [r["n_tokens"] for r in token_counts.count_tokens(twice, PIECES).collect()] == [2, 2]
    assert token_counts.count_tokens(twice.limit(0), PIECES).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------------


def test_pfair_deviates_by_less_than_a_block():
    for shares in ({"a": 1, "b": 1, "c": 1}, {"a": 500, "b": 300, "c": 1, "d": 199}, {"a": 7, "b": 5, "c": 3, "d": 2}):
        total, done = sum(shares.values()), dict.fromkeys(shares, 0)
        for s, k, slot, release, deadline in mixing.pfair_period(shares):
            assert release <= slot < deadline and k == done[s]
            done[s] += 1
            assert all(abs(done[x] - shares[x] * (slot + 1) / total) < 1 for x in shares)
        assert done == shares


def test_mixing_places_every_row_once(spark):
    rows = [(i, "t", "en", [None, "a", "b", ""][i % 4] if i % 3 else "hot", 1) for i in range(900)] + [(5, "t", "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_slot long")
    got = mixing.mix(docs, {"hot": 5, "a": 2, "b": 2, None: 1}, block_docs=4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    places = collections.defaultdict(list)
    for r in got:
        places[r["source"], r["mix_block"]].append((r["mix_slot"], r["mix_offset"]))
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    assert all(len({s for s, _ in v}) == 1 and sorted(o for _, o in v) == list(range(len(v))) for v in places.values())
    assert len({v[0][0] for v in places.values()}) == len(places)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [900, 1000, 3000])
def test_tempered_shares_follow_the_weights_of_many_sources(n):
    counts = {"hot": n * n // 4} | {f"s{i}": 1 + i % 50 for i in range(n - 1)}
    shares = mixing.tempered_shares(counts, 0.5, 1000)
    assert min(shares.values()) >= 1 and set(shares) == set(counts)
    target = sum(shares.values()) * (n / 2) / sum(c**0.5 for c in counts.values())
    assert (1 - 1 / mixing.SOURCE_SLOTS) * target - 1 < shares["hot"] < target + 1


@pytest.mark.parametrize("held", [100, 1 << 20])
def test_mixing_many_sources_with_one_hot(spark, monkeypatch, held):
    monkeypatch.setattr(mixing, "PERIOD_ROWS", 20_000 if held == 100 else held)
    docs = spark.range(6600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 1100)).alias("source"))
    got = mixing.mix(docs, block_docs=1).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6600)) and len({r["mix_slot"] for r in got}) == 6600
    counts = collections.Counter(r["source"] for r in got)
    w = counts["hot"] ** 0.5 / sum(c**0.5 for c in counts.values())
    assert counts["hot"] == 2200 and all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    first = sorted(r["mix_slot"] for r in got if r["source"] == "hot")
    assert abs(len(first) / (first[-1] + 1) / w - 1) < 1 / mixing.SOURCE_SLOTS


def test_mixing_keeps_weight_zero(spark):
    docs = spark.createDataFrame([(i, "abz"[i % 3]) for i in range(300)], "doc_id long, source string")
    got = mixing.mix(docs, {"a": 3, "b": 1, "z": 0}, block_docs=4).collect()
    assert len(got) == 300 and max(r["mix_slot"] for r in got if r["source"] != "z") < min(r["mix_slot"] for r in got if r["source"] == "z")
    assert len({(r["mix_slot"], r["mix_offset"]) for r in got}) == 300
    assert mixing.mix(docs, {"a": 0, "b": 0, "z": 0}).count() == 300
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1})


def test_marks_of_held_words_are_apart_from_their_sets(spark):
    """The constant goes first, so that a word's mark isn't a function of the hash that chooses its set."""
    w = spark.createDataFrame([("word",)], "w string")
    mark, chained = w.select(byte_bpe._mark(F.col("w")), F.xxhash64("w", F.lit(1))).first()
    first = xxhash.xxh64((1).to_bytes(4, "little"), seed=42).intdigest()
    assert mark % 2**64 == xxhash.xxh64(b"word", seed=first).intdigest() != chained % 2**64


def test_components_of_few_edges_take_few_tasks(spark):
    """A step reads its few edges in few tasks, not in one for each shuffle partition of the step before."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker, group = spark.sparkContext.statusTracker(), "components of few edges"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        got = jaccard_join.components(spark.createDataFrame([(i, i + 1) for i in range(8)] + [(20, 21)], "a long, b long"))
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
        assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(9)} | {(20, 20), (21, 20)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks < 1500
