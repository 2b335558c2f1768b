import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from small import lines_left

from textloom.llm import bpe, chat_tree, components, exact_dedup, langid, line_dedup, minhash, mixing, secrets, topk, warc

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, band long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near_rows():
    rng = random.Random(4)
    base = prose(rng, 400)
    rows = [(10, None), (11, ""), (12, " \n"), (13, "one"), (14, "ONE"), (15, "a b"), (16, base), (17, base), (17, base)]
    for i in range(25):
        w = base.split()
        for _ in range(rng.randint(1, 22)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
        rows.append((20 + i, " ".join(w)))
    rows += [(60 + i, prose(rng, rng.randint(3, 60))) for i in range(20)]
    rows += [(90, "x " * 3000), (None, "nobody knows this text")]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "clash", 1) for i, t in rows], DOCS)


def test_near_duplicates(spark):
    rows = near_rows()
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a is not None and b is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(as_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), None if r["doc_id"] is None else find(r["doc_id"]))
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(as_docs(spark, rows).limit(0)).count() == 0


def test_hyperminhash_estimate():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (1500, 250, 250))
    x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
    assert abs(minhash.estimate(minhash.registers_large(x), minhash.registers_large(y), 1750, 1750, 0) - 0.75) < 0.12
    assert minhash.estimate(minhash.registers_large(np.sort(a)), minhash.registers_large(np.sort(b)), 250, 250, 0) < 0.05


def test_lines(spark):
    long = "the quick brown fox jumps over the lazy dog again and again until the night falls over the hill " * 3
    rows = [(1, "Keep me\n" + long + "\nfive words are in here"), (2, long.upper() + "\nother words in this one line"), (3, "Five words, are in here!\nkeep me"), (4, None), (5, ""), (6, "a b c d 12\nx"), (7, "a b c d 34\nx"), (8, "same text in both rows"), (8, "same text in both rows")]
    out = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(as_docs(spark, rows)).select("doc_id", "text").collect()}
    assert out == {(1, rows[0][1]), (2, "other words in this one line"), (3, "keep me"), (4, None), (5, ""), (6, rows[5][1]), (7, "x"), (8, "same text in both rows")}
    assert line_dedup.dedup_lines(as_docs(spark, rows).limit(0)).count() == 0


def test_simhash_blocks_find_all_near_lines():
    rng = random.Random(2)
    lines = [prose(rng, 40) for _ in range(150)]
    lines += [x.replace(" mu ", " ny ", 1) for x in lines]
    data = "\n".join(lines).encode()
    _, _, _, node, sim = line_dedup.line_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    s = sim.view(np.uint64)
    near = {(i, j) for i in range(len(s)) for j in range(i) if int(s[i] ^ s[j]).bit_count() <= line_dedup.DISTANCE}
    for blocks in {line_dedup.blocks_for(n) for n in (0, 10**6, 10**8, 10**11)}:
        keys = line_dedup.band_keys(s, blocks).T
        assert near and all((keys[i] == keys[j]).any() for i, j in near)
    assert line_dedup.edits("kitten", "sitting") == 3 and line_dedup.similar("abcde", "abcdx", 0.8) and not line_dedup.similar("abcd", "abcx", 0.8)


def test_edit_distance_and_votes():
    rng = random.Random(5)
    for _ in range(300):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in "xy")
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = _next_row(row, i, c, y)
        assert line_dedup.edits(x, y) == row[-1]
        for most in range(6):
            assert (line_dedup.edits(x, y, most) <= most) == (row[-1] <= most)
    n = np.array([1, 254, 255, 256, 700])
    h = np.random.default_rng(1).integers(0, 2**63, n.sum(), dtype=np.uint64)
    first = np.cumsum(n) - n
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    assert (line_dedup.bit_votes(h, first, n) == np.add.reduceat(bits, first, axis=0)).all()


def _next_row(row, i, c, y):
    out = [i]
    for j, d in enumerate(y, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
    return out


def test_line_blocks_link_as_brute_force(spark, monkeypatch):
    """Bands larger than two members go through leaders and blocks."""
    monkeypatch.setattr(components, "SMALL_BAND", 2)
    monkeypatch.setattr(components, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(components, "BLOCK", 8)
    rng = random.Random(6)
    bases = [prose(rng, 60).split() for _ in range(3)]
    lines = []
    for k in range(60):
        w = list(bases[k % 3])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = rng.choice(["q", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "mu"]) + str(k)
        lines.append(" ".join(w))
    docs = as_docs(spark, list(enumerate(lines)))
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs).filter("n_removed = 1").collect()}
    normal = [line_dedup.normal_form(x.encode()).decode() for x in lines]
    data = "\n".join(lines).encode()
    sim = line_dedup.line_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[4].view(np.uint64)
    top = list(range(60))
    for i in range(60):
        for j in range(i):
            if normal[i] == normal[j] or int(sim[i] ^ sim[j]).bit_count() <= line_dedup.DISTANCE and line_dedup.similar(normal[i], normal[j], 0.8):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    assert got == {i for i in range(60) if top[i] != i} and got


def test_long_lines_are_compared_whole():
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3500))
    head = "".join(rng.choice("klmnopqr ") for _ in range(300))
    for x in (long[:20_000], long[:5000], long[:4001]):
        assert line_dedup.similar(x, head + x, 0.8) and line_dedup.similar(head + x + "end", "start" + x, 0.8)
    assert not line_dedup.similar(long[:5000], long[5000:10_000], 0.8)


def test_short_lines_and_lines_without_spaces(spark):
    han, token = "机器学习模型需要大量干净的训练数据才能得到好的结果", "0123456789abcdef" * 5
    rows = [(1, f"All rights reserved.\n{han}\n{token}\n}}\n—\n\nRead more"), (2, f"Read more\n All rights reserved.\r\n{han}\n{token}\n}}\n—\n\nALL RIGHTS RESERVED."), (3, han.replace("学", "学 ") + "\nthis line has no other copy")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(as_docs(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "}\n—\n\nALL RIGHTS RESERVED.", 3: "this line has no other copy"}
    data = "\n".join([han, han + "了", token * 4, "x" + token * 4, "All rights"]).encode()
    _, _, n, _, sim = line_dedup.line_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    bits = [int(x) for x in sim.view(np.uint64)]
    assert n.tolist() == [1, 1, 1, 1, 2] and 0 < (bits[0] ^ bits[1]).bit_count() < 16


def test_shingled_lines_find_near_copies(spark):
    """Lines with one word or a tenth of them replaced, against all pairs of an edit similarity of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    lines = [[word() for _ in range(n)] for n in (8, 10, 12, 20, 30, 60) for _ in range(20)]
    for w in list(lines):
        w = list(w)
        for i in rng.sample(range(len(w)), max(1, len(w) // 10)):
            w[i] = word()
        lines.append(w)
    han = "机器学习模型需要大量干净的训练数据才能得到好的结果"
    lines = [" ".join(w) for w in lines] + [han, han.replace("干净", "新鲜"), han[3:] + "了"]
    normal = [line_dedup.normal_form(x.encode()).decode() for x in lines]
    late = {j for j in range(len(lines)) for i in range(j) if line_dedup.similar(normal[i], normal[j], 0.8)}
    out = line_dedup.dedup_lines(as_docs(spark, list(enumerate(lines))), shingled=True)
    got = {r["doc_id"] for r in out.filter("n_removed = 1").collect()}
    assert len(late) > 110 and got <= late and len(got) >= 0.98 * len(late) and len(lines) - 1 in got


def test_top_k_of_repeated_query_ids(spark):
    rows = [(50, [float(x), 1.0]) for x in (3, -2, 2, 1)] + [(1, [1.0, 0.0]), (2, [-1.0, 0.0])]
    for order in (rows, rows[::-1], rows[2:] + rows[:2], rows[1:] + rows[:1]):
        vectors = spark.createDataFrame(order, "vec_id long, embedding array<double>").coalesce(1)
        got = topk.exact_top_k(vectors, lambda i: i == 50, 2).orderBy("rank").collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(50, 2, 2 * 256 * 256), (50, 1, -2 * 256 * 256)]


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", chat_tree.FORGED), (3, 0, "a:b\\", "<#\\\n"), (3, 0, None, ""), (None, 5, "assistant", "x"), (4, 0, "user", "hi"), (4, 1, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    packs = chat_tree.format_tree(df)
    got = {r["conv_id"]: r for r in chat_tree.read_back(packs).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(p["pack_text"].count("user: hi") for p in packs.collect()) <= packs.count()
    many = chat_tree.read_back(chat_tree.format_tree(df, pack_chars=1, pack_leaves=1)).collect()
    assert sorted(map(str, many)) == sorted(map(str, got.values()))
    assert chat_tree.read_back(chat_tree.format_tree(df.limit(0))).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), ["en", "de", None][i % 3 if i % 5 else 0], ["hot", "b", "c"][min(2, i % 6)], None) for i in range(600)] + [(1000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_sources(docs, 0.5).toPandas()
    assert len(out) == 601 and (out["tokens"] * out["probability"]).sum() == pytest.approx(0.5 * out["tokens"].sum(), rel=1e-6)
    assert out.loc[out["doc_id"] == 1000, "sampled"].all() and out["probability"].between(0, 1).all()
    cells = spark.createDataFrame([("a", "x", "t", 10), ("a", "y", "t", 20), ("b", "x", "t", 30), ("b", "y", "t", 40)], "source string, lang string, topic string, tokens long")
    want = {d: spark.createDataFrame(v, f"{d} string, target double") for d, v in (("source", [("a", 0.5), ("b", 0.5)]), ("lang", [("x", 0.3), ("y", 0.7)]), ("topic", [("t", 1.0)]))}
    raked = mixing.rake(cells, want).toPandas()
    assert raked.groupby("source")["weight"].sum().tolist() == pytest.approx([0.5, 0.5], abs=1e-4)
    assert raked.groupby("lang")["weight"].sum().tolist() == pytest.approx([0.3, 0.7], abs=1e-4)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://www.B.com/x y", big), (3, "http://b.com:80/x", big), (4, None, None), (6, "bad://[", "small"), (7, "http://a.com/", "small"), (8, "http://b.com/x", big + "1")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=2)
    records = warc.read_archives(spark, str(tmp_path / "w")).drop("payload").persist()
    got = {r["record_id"]: r for r in records.collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), 3 if i == 5 else None)
    index = warc.capture_index(records).collect()
    assert [(r["url_key"], r["ts"], r["record_id"]) for r in index] == sorted((r["url_key"], r["ts"], r["record_id"]) for r in index)
    runs = [sorted(random.Random(k).choices(range(50), k=20)) for k in range(5)] + [[]]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))
    with pytest.raises(ValueError, match="record"):
        list(warc.parse_archive(b"nothing\r\n\r\n"))


def test_secrets_learn_from_all_documents(spark, monkeypatch):
    """the network and its threshold came from 2,000 documents with findings and 2,000 without, and 16 candidates of each."""
    rng = random.Random(4)
    token = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    rows = [(i, f"{prose(rng, 9)} " + " ".join(f"secret={token(26)}" for _ in range(20 if i == 7 else i % 2))) for i in range(120)]
    monkeypatch.setattr(secrets, "SHARD", 40)
    found = secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    spans = found.selectExpr("sum(size(kinds))").first()[0]
    net = secrets.train(found)
    examples = spark.createDataFrame([r for b in found.selectExpr("xxhash64(doc_id) AS h", "kinds", "windows", "word", "said").toArrow().to_batches() for x in secrets._examples([b]) for r in x.to_pylist()], "key long, held boolean, yes boolean, window binary")
    words = found.filter("word IS NOT NULL").count()
    assert words > 50 and examples.count() == spans + 3 * words
    one = secrets._fit(examples, 3, 1)
    assert one.seen == examples.filter("NOT held").count() and one.trained
    assert net.trained and net.recall >= secrets.RECALL
    assert [secrets._fit(examples.repartition(5), 3, 1).threshold] == [one.threshold]  # however the examples lie


def test_secrets(spark):
    rng = random.Random(3)
    token = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    rows = [(i, f'{prose(rng, 30)} Token = "{token(30)}" {prose(rng, 9)}') for i in range(60)] + [(100 + i, prose(rng, 40) + " unremarkablelongword.inprose") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "é password: abc, AKIA" + "A" * 15 + " AKIA" + "B" * 16), (202, "é"), (203, "secret=secret=abcdef token:x"), (204, "a" * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kinds int")
    got = sorted((r["doc_id"], [x for x in zip(r["starts"], r["kinds"], r["ends"], strict=True) if x[1] < 3]) for r in secrets.scan_secrets(docs).collect())
    assert got == sorted((i, secrets.base_spans(t or "")) for i, t in rows)
    assert secrets.base_spans(rows[-4][1] if rows[-4][0] == 202 else rows[-5][1])
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_exact(spark):
    rows = [(5, "a b"), (2, "ab"), (9, " a\tb "), (9, " a\tb "), (1, None), (7, ""), (8, "\n"), (3, "solo"), (None, "ab  ")] + [(100 + i, "hot") for i in range(80)]
    got = exact_dedup.exact_dedup(as_docs(spark, rows), k=3).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), float("inf") if i is None else i, i))
    want = sorted((str(i), min(g)[2], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, _, i in g)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_dedup(as_docs(spark, rows).limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 8).round(2).tolist()) for i in range(120)] + [(200 + i, [0.1] * 8) for i in range(30)]
    rows += [(50, [0.5] * 8), (300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (350, []), (400, [1.0, 2.0]), (401, [1.0, 0.0])]
    got = sorted(map(tuple, topk.exact_top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int"), lambda i: i % 50 == 0).filter("query_id <> 50").collect()))
    fine = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in fine:
        if q % 50 == 0 and q != 50:
            best = sorted((-int(x @ y), i) for i, y in fine if i != q and len(y) == len(x))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_language(spark):
    rng = random.Random(1)
    vocab = {"en": ["the", "of", "thing", "with"], "de": ["der", "schön", "nicht", "über"], "xx": ["qua", "quo", "qui", "zzyx"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(["en", "de", "xx"] * 60)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "the " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    held = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = langid.train(docs.limit(0))
    assert langid.identify(docs, empty, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def test_bpe(spark):
    import tiktoken

    path, pattern = bpe.vocabulary()
    own = bpe.Codec(open(path, "rb").read(), pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(0)
    texts = ["", " ", "a\n\n b", "don't  stop\t\n", "a" * 5000, "<|endoftext|>", "😀é中\u0085\x1c"] + ["".join(rng.choice("ab é\n\t1中'st") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    ids, per = own.encode(texts)
    ends = np.cumsum(per)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, per, strict=True)] == [theirs.encode_ordinary(t) for t in texts]
    assert [bytes(x).decode() for x in own.decode(ids, per)] == texts
    df = spark.createDataFrame([(1, None), (1, "hello world"), (None, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"], tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.tokenise(df, path, pattern, ["doc_id"], ["n_tokens", "ids", "decoded"]).collect()}
    assert got == {(1, 0, (), b""), (1, 2, tuple(theirs.encode_ordinary("hello world")), b"hello world"), (None, 0, (), b"")}
    with pytest.raises(ValueError, match="clash"):
        bpe.tokenise(df.withColumnRenamed("doc_id", "ids"), path, pattern, ["ids"], ["ids"])
    assert pa.array([1]) is not None


def test_many_lines_with_one_passage(spark):
    """More lines than a band gives pairs of: they meet in blocks, and near copies among them are found."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    passage = [word() for _ in range(9)]
    texts = [" ".join([*passage, *(word() for _ in range(9))]) for _ in range(150)]
    for i in range(0, 150, 5):  # a copy with another last word, and one of a copy
        texts.append(" ".join([*texts[i].split()[:-1], word()]))
        texts.append(" ".join([*texts[-1].split()[:-2], word(), texts[-1].split()[-1]]))
    rows = list(enumerate(texts))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingled=True)
    left = lines_left(rows)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == left and sum(not t for t in left.values()) >= 60
