"""The pipeline's stages against brute force, each on what the one before kept."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from test_pairs_and_repeats import brute_components, brute_tiles
from test_rules_and_models import base

import corpus_pipeline
from vantarow.llm import packing, pii, quality


def texts(seed=31):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [prose(20) for _ in range(4)]
    out = [prose(r.randint(55, 140)) for _ in range(40)]
    out += [t.replace("word1", "Word1", 1) for t in out[:6]] + [" ".join([*t.split()[:-1], "changed"]) for t in out[6:12]]  # near copies
    out += ["### $$$ ||| " * 6 + " ".join(w + "##$$" for w in prose(60).split()) for _ in range(20)]  # labelled bad
    out += [f"{prose(40)} {item} {prose(10)}" for item in items] + [f"{prose(40)} {' '.join(items[0].split()[10:])} then {' '.join(items[0].split()[:10])} {prose(9)}"]
    out += [f"{prose(60)} mail bob{k}@example.com or call +1 555 010 99{k}2 from 10.0.0.{k}" for k in range(5)]
    return [*out, "too short", "", None, "again and " * 60], items


def test_stages(spark, tmp_path):
    rows, items = texts()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labelled = [(i, int("##" not in (t or "")), 0) for i, t in enumerate(rows)]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name == ("quality_rules", "ngram_join", "decontamination", "pii", "packing")[k] and (k == 4 or out.columns == docs.columns)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            kept.append({r.doc_id: r.text for r in docs.collect()})
            assert docs.count() == len(kept[-1])
    # quality: the base by counting, the list's branches one by one in plain Python
    rules = quality.fitted(quality.text_stats(spark.read.parquet(str(tmp_path / "documents.parquet"))), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert rules
    want = {}
    for d, t in kept[0].items():
        t = t or ""
        w = t.split()
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip()]
        chars, n = sum(map(len, w)), max(1, len(w))
        have = {
            "words": len(w), "word_length": chars / n, "symbols": len(re.findall(r"[#*$%&|<>]", t)) / max(1, chars), "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "repeats": len(again) / n,
            "upper": sum(c.isupper() for c in t) / max(1, chars), "line_words": len(w) / max(1, len(lines)),
        }
        rejected = any(all(have[f] > at if above else have[f] <= at for f, above, at in rule) for rule in rules)
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and not rejected:
            want[d] = t
    assert kept[1] == want and not any("##" in t for t in kept[1].values())
    # near copies: the least document of each group stays
    ids = sorted(kept[1])
    assert kept[2] == {d: kept[1][d] for k, d in enumerate(ids) if brute_components([kept[1][x] for x in ids])[k][1] == k} and len(kept[2]) <= len(kept[1]) - 12
    # benchmark: at least half of an item's tokens lie in its tiles of five tokens or more
    token = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    leaked = {d for d, t in kept[2].items() if any(2 * sum(n for _, _, n in brute_tiles(token(t), token(i), 5)) >= len(token(i)) for i in items)}
    assert len(leaked) == 5 and kept[3] == {d: t for d, t in kept[2].items() if d not in leaked}
    # personal data: every span that is reported is replaced, none of the base patterns is left, other texts stay
    spans = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(kept[3].items()), "doc_id long, text string")).collect()}
    for d, t in kept[3].items():
        out, last = "", 0
        for kind, a, b in (x.split(":") for x in spans[d].split(",") if x):
            out, last = out + t[last : int(a)] + f"[{kind.upper()}]", int(b)
        assert kept[4][d] == out + t[last:] and not base(kept[4][d])
    assert kept[4].keys() == kept[3].keys() and sum("[EMAIL]" in t for t in kept[4].values()) == 5
    # packing: every document whole, gapless, no sequence over its size
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    placed: dict[int, list] = {}
    length = Counter()
    for r in docs.collect():
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        length[r.doc_id] += r.length
    assert length == {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept[4].items()}
    for pieces in placed.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(placed) == -(-sum(length.values()) // 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert tuple(whole) == (sum(length.values()), len(kept[4]))
