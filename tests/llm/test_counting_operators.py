"""Phrases, conversation tries and byte-level encodings against brute force and the tiktoken library."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelweave.llm import byte_bpe, collocations, turn_trie
from panelweave.llm.queries import BYTE_BPE


def phrases_of(rows, least, top=2000, percent=100):
    f=collections.defaultdict(collections.Counter); n=collections.Counter()
    for lang,text in rows:
        lang="und" if lang is None else lang
        t="".join(chr(ord(c)+32) if "A"<=c<="Z" else c for c in (text or ""))
        for p in re.split("[.,;:!?\x0a-\x0d]",t):
            w=re.findall("[^ \t]+",p); n[lang]+=len(w)
            for k in range(1,6):
                for i in range(len(w)-k+1): f[lang][tuple(w[i:i+k])]+=1
    out=[]
    for lang in f:
        F=f[lang]; N=n[lang]
        cand=[p for p in F if 2<=len(p)<=5 and F[p]>=least]
        keep=[]
        for p in cand:
            if any(len(q)>len(p) and 100*F[q]>=percent*F[p] and any(q[i:i+len(p)]==p for i in range(len(q)-len(p)+1)) for q in cand): continue
            s,k=min((1000*F[p]*N//(F[p[:k]]*F[p[k:]]),k) for k in range(1,len(p)))
            keep.append((-s,-F[p]," ".join(p).encode(),F[p[:k]],F[p[k:]]))
        for i,(s,a,p,l,r) in enumerate(sorted(keep)[:top]): out.append((lang,i+1,p.decode(),-a,l,r,N,-s))
    return sorted(out)


def nodes_of(rows):
    convs={}
    for c,t,r,x in rows:
        if c is None: continue
        r,x=r or "",x or ""
        h=hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
        convs.setdefault(c,[]).append(((t is not None, t or 0), h[:32], r, x))
    for c in convs: convs[c]=[(r,x) for _,_,r,x in sorted(convs[c])]
    new={}
    for c,own in convs.items():
        h=zlib.crc32(str(c).encode())%9
        p=c-int(abs(c)%5*(1 if c>=0 else -1))
        new[c]=tuple(convs.get(p,[])[:h]+own[h:])
    mem={}
    for c,s in new.items():
        for d in range(len(s)+1): mem.setdefault(s[:d],[]).append(c)
    kids={}
    for s in mem:
        if s: kids.setdefault(s[:-1],[]).append(s)
    out=[]
    def sub(s):
        st=[s]
        while st:
            x=st.pop(); yield x; st+=kids.get(x,[])
    for s,m in mem.items():
        S=list(sub(s))
        ends=",".join(map(str,sorted(c for c in m if len(new[c])==len(s))))
        out.append((min(m),len(s),min(mem[s[:-1]]) if s else None,len(m),len(kids.get(s,[])),sum(1 for x in S if x not in kids),sum((len(mem[x])-1)*len(x[-1][1].encode()) for x in S if x),hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("frequent", "ranked", "top", "percent"), [(2_000_000, 200_000, 2000, 100), (0, 3, 5, 50), (5, 10, 9, 90)])
def test_phrases_equal_brute_force(spark, monkeypatch, frequent, ranked, top, percent):
    monkeypatch.setattr(collocations, "FREQUENT_ROWS", frequent)  # with 0, all semi-joins shuffle
    monkeypatch.setattr(collocations, "RANKED", ranked)
    rnd = random.Random(top)
    words = ["the", "of", "A", "é", "x\xa0y", "to", "B"] + [f"w{i}" for i in range(40)]
    text = lambda: rnd.choice([" ", "\t", ""]) + "".join(rnd.choice(words[: rnd.choice([3, 7, 47])]) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", ","]) for _ in range(rnd.randrange(60)))
    rows = [(rnd.choice(["en", "en", "fr", None, ""]), None if rnd.random() < 0.1 else text()) for _ in range(200)]
    rows += rows[:20] + [("fr", "long " * 100_000)]
    docs = spark.createDataFrame([(lang, t, i, "x", "y") for i, (lang, t) in enumerate(rows)], "lang string, text string, id int, words string, runs string").repartition(5)
    assert sorted(map(tuple, collocations.collocations(docs, least=5, top=top, percent=percent).collect())) == phrases_of(rows, 5, top, percent)
    if ranked == 3:
        assert collocations.collocations(docs.limit(0)).count() == collocations.collocations(docs, least=10**7).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    # 1000 a n is 1.2e19 and more here: over the range of 64-bit integers
    parts = [("x", 10**8, 12 * 10**7)]
    row = spark.createDataFrame(parts, "w string, a long, n long").selectExpr("(1000BD * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(7 as decimal(19,0)) * cast(11 as decimal(19,0))) as s").first()
    assert row.s == 1000 * 10**8 * 12 * 10**7 // 77


@pytest.mark.parametrize(("cells", "bits", "shards", "most"), [(7, 2, 8, 60), (50, 12, 3, 250), (1 << 20, 3, 1, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, cells, bits, shards, most):
    monkeypatch.setattr(turn_trie, "LIST_BITS", bits)
    monkeypatch.setattr(turn_trie, "SHARDS", shards)
    rnd = random.Random(most)
    rows = [
        (c, rnd.choice([t, t, t, None, 0]), rnd.choice(["user", None, "bot"]), rnd.choice(["a", "a", "bé", None, ""]))
        for c in range(-20, most) if rnd.random() < 0.85 for t in range(rnd.randrange(1, 12))
    ]
    rows += [(None, 1, "a", "b")] * 3 + [(7, t, "u", f"x{t % 3}") for t in range(300)] + [(8, 0, "u", "long " * 50_000)] + rows[:9]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, id int, key string").repartition(5)
    assert sorted(map(tuple, turn_trie.prefix_trie(table, cells=cells).collect()), key=str) == sorted(nodes_of(rows), key=str)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    table = spark.createDataFrame([(c, 0, "u", "x") for c in (1, 2, 3)], "conv_id long, turn long, role string, text string")
    assert turn_trie.prefix_trie(table.limit(0)).count() == turn_trie.prefix_trie(table.selectExpr("null as conv_id", "turn", "role", "text")).count() == 0
    assert [tuple(r) for r in turn_trie.prefix_trie(table).collect()] == nodes_of([(c, 0, "u", "x") for c in (1, 2, 3)])


@pytest.fixture(scope="module")
def replay():
    with open(BYTE_BPE, encoding="utf-8") as f:
        return byte_bpe.MergeReplay(f.read())


@pytest.fixture(scope="module")
def library(replay):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})


def random_text(rnd):
    kind, n = rnd.random(), rnd.randrange(60)
    if kind < 0.5:
        return "".join(rnd.choice("ab aA\n\t  '.,1" if kind < 0.3 else "aaaabbbcd ") for _ in range(n))
    spans = [(32, 127), (0xA0, 0x600), (0x4E00, 0x5000), (0x1F300, 0x1F700), (1, 33), (0x2000, 0x2030)]
    return "".join(chr(rnd.randrange(*rnd.choice(spans))) for _ in range(n))


def test_byte_encodings_equal_the_library(replay, library):
    rnd = random.Random(5)
    texts = [random_text(rnd) for _ in range(20_000)] + ["a" * 5000, "ab" * 3000 + " " * 5000, "我" * 3000, "x ", " x", "  ", "a\n b", "a \n b", "<|endoftext|>", "\x1c x\x85 y"]
    encoder = byte_bpe.Encoder(replay, keep_bytes=1 << 19)  # several generations
    coded = [c for i in range(0, len(texts), 3000) for c in encoder.encode(texts[i : i + 3000])]
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == library.encode_ordinary_batch(texts)
    assert [replay.decode(c).decode() for c in coded] == texts


def test_words_that_leave_the_replay_are_encoded_by_themselves():
    # 'bc' merges first, but makes a pair of a lower rank than its own: the whole of 'abc' came before 'bc'
    ranks = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"cd", b"abcabc"]
    replay = byte_bpe.MergeReplay("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(ranks)))
    alone = tiktoken.Encoding("odd", pat_str=".+", mergeable_ranks=replay.ranks, special_tokens={})
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    got = [np.frombuffer(c, "<u4").tolist() for c in replay.encode_words(words)]
    assert got == [replay.encode_word(w) for w in words] == [alone.encode_ordinary(w.decode()) for w in words]


def test_byte_encoding_of_edge_cases(spark, library):
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (5, "x " * 60_000), (None, "no id"), (6, "Ünïcode 中文 \U0001f600"), (7, "y" * 3_000_000)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, ids int, decoded string")
    found = byte_bpe.encode_decode(docs, BYTE_BPE).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in found], key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.ids) // 4 for r in found)
    assert byte_bpe.encode_decode(docs.limit(0), BYTE_BPE).count() == 0
