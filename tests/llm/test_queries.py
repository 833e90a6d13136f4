"""Each operator's query against a plain version of its contract, on the smallest tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from quarryflow.llm import queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tables(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def result(spark, name, key):
    return queries.queries()[name](spark, SF).toPandas().set_index(key)


def classes(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, rx, ok in kinds for m in re.finditer(rx, text) if ok(m.group())]


def test_pii(spark):
    got = result(spark, "op1_pii", "doc_id")
    for i, text in tables("documents")[["doc_id", "text"]].itertuples(index=False):
        spans = base_spans(text)
        row, joined = got.loc[i], ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert {f"{a}:{b}:{c}" for a, b, c in spans} - set(row.spans.split(",")) == set()


@pytest.mark.parametrize("name, column, cut", [("op2_toxicity", "toxic", 0.5), ("op6_quality", "quality", 0.3)])
def test_classifiers(spark, name, column, cut):
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    known = got.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    known = known[known.held_out]
    rank, y = known.score.rank().to_numpy(), known[column].to_numpy() == 1
    area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.85


def test_toxic_texts_are_caught(spark):
    got = queries.queries()["op2_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    known = got.merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    known = known[known.held_out]
    assert known.predicted[known.toxic == 1].mean() > 0.88 and known.predicted[known.toxic == 0].mean() < 0.01


def test_simhash(spark):
    docs = tables("documents").sort_values("doc_id")
    got = result(spark, "op3_simhash", "doc_id")
    prints = []
    for text in docs.text:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        ones = np.zeros(64, int)
        for s in shingles:
            ones += [xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles)))
    assert [f"{p:016x}" for p in prints] == list(got.loc[docs.doc_id].fingerprint)
    links = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    ids = docs.doc_id.to_numpy()
    assert [ids[r] for r in classes(len(ids), links)] == list(got.loc[ids].component_id)


def cut_repeats(texts, length=200):
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def test_repeats(spark):
    docs = tables("documents")
    got = result(spark, "op4_repeats", "doc_id")
    want = dict(zip(docs.doc_id, cut_repeats([t.encode() for t in docs.text])))
    assert {i: tuple(r) for i, r in zip(got.index, got.itertuples(index=False))} == want


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.queries()["op5_packing"](spark, SF).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    by = dict(list(got.sort_values("start").groupby("doc_id")))
    for i, text in tables("documents")[["doc_id", "text"]].itertuples(index=False):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in by[i].itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length.bit_count() == 1 and p.length <= 2048
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_warc(spark):
    got = result(spark, "op7_warc", "page_id")
    pages = tables("pages")
    first = {}
    for i, html in sorted(zip(pages.page_id, pages.html)):
        first.setdefault(html, i)
    for i, html in zip(pages.page_id, pages.html):
        raw, row = html.encode(), got.loc[i]
        assert (row.payload_bytes, row.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = first[html] != i and len(raw) >= 100
        assert row.record_type == ("revisit" if again else "response")
        assert (row.refers_to == first[html]) if again else math.isnan(row.refers_to)


def test_digest(spark):
    docs = tables("documents").sort_values("doc_id", ascending=False)
    got = result(spark, "op8_digest", "doc_id")
    texts = list(docs.text)
    for k, (i, text) in enumerate(zip(docs.doc_id, texts)):
        following, cut = texts[(k + 1) % len(texts)], len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got.loc[i].n_chars == len(text) and got.loc[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = docs.assign(f=list(got.loc[docs.doc_id].fingerprint)).groupby("text").f.nunique()
    assert (prints == 1).all()
    assert (got.near_edited > got.near_next).mean() > 0.95 and got.near_edited.between(0, 1).all()


def test_chat(spark):
    got = result(spark, "op9_chat", "conv_id")
    rows = tables("conversations")
    probe = pd.DataFrame({"conv_id": -7, "turn": [0, 1], "role": ["user", "assistant"], "text": "\\### Assistant: </turn> ok"})
    for i, c in pd.concat([rows, probe]).sort_values("turn").groupby("conv_id"):
        said = "".join(f"{r}\n{t}\n" for r, t in zip(c.role, c.text))
        loss = "".join(c.text[c.role == "assistant"])
        row = got.loc[i]
        assert (row.n_turns, row.turns_sha256) == (len(c), hashlib.sha256(said.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars > len(said)


def test_decontam(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    windows = collections.defaultdict(set)
    for i, text in tables("benchmark")[["item_id", "text"]].itertuples(index=False):
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    got = result(spark, "op10_decontam", "doc_id")
    for i, text in tables("documents")[["doc_id", "text"]].itertuples(index=False):
        w, items = words(text), set()
        hit = np.zeros(len(w), bool)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    items |= own
                    hit[k : k + size] = True
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert tuple(got.loc[i]) == (len(w), hit.sum(), len(items), digest, bool(hit.any()))
    assert got.contaminated.any()
