import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from stratafile.llm import decontaminate, language_id
from stratafile.llm.common import table, written
from test_mixing import water
from test_near_copies import slow_components

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents").collect()
    frame = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_dedup", "decontamination", "mix", "shard"]
    # language: letters and a score
    rank = language_id.Ranker(language_id.learn(frame.where(~language_id.held_out(frame.doc_id))))
    odd = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "12 34 !!", "en", "src0", 8), (10_003, "漢字漢字" * 40, "en", "src0", 160)], frame.schema)
    got = stages["language"](spark, frame.unionByName(odd), SF)
    assert got.columns == frame.columns
    want = [d for d in docs if rank(d.text)[1] >= language_id.LEAST]
    assert sorted(r.doc_id for r in got.collect()) == sorted(d.doc_id for d in want) and len(want) == len(docs)
    # near duplicates
    got = stages["near_dedup"](spark, got, SF)
    least = slow_components([(d.doc_id, d.text) for d in want])
    want = [d for d, c in zip(want, least) if d.doc_id == c]
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == sorted(d.doc_id for d in want) and len(want) < len(docs)
    # benchmark items, whole, as the tables plant them
    got = stages["decontamination"](spark, got, SF)
    items = [" ".join(decontaminate.tokens(r.text)) for r in table(spark, SF, "benchmark").collect()]
    want = [d for d in want if not any(x in " ".join(decontaminate.tokens(d.text)) for x in items)]
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == sorted(d.doc_id for d in want)
    # mix: whole documents, near the targets
    got = stages["mix"](spark, got, SF)
    assert got.columns == frame.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for d in want:
        by[d.source] += size(d.text)
    goal = dict(zip(sorted(by), water([by[s] for s in sorted(by)])))
    mixed, took = got.collect(), defaultdict(int)
    for r in mixed:
        took[r.source] += size(r.text)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    longest = max(size(d.text) for d in want)
    assert all(abs(took[s] - goal[s]) <= longest for s in goal)
    # shards
    got = stages["shard"](spark, got, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((r.doc_id, len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in mixed)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_dedup_of_repeated_ids(spark):
    frame = table(spark, SF, "documents")
    twice = frame.unionByName(frame.where("doc_id < 50"))
    once = corpus_pipeline.near_dedup(spark, frame, SF).collect()
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, twice, SF).collect()) == sorted(r.doc_id for r in once)
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), SF).collect() == []


def test_stages_on_odd_rows(spark):
    """Null and empty texts, repeated rows, missing ids and clashing columns pass through every stage."""
    names = ["_own_id", "_own_slot", "component_id", "node", "shard", "slot", "size", "taken", "score", "lang_pred", "S", "position"]
    prose = table(spark, SF, "documents").where("doc_id < 12").collect()
    rows = [(d.doc_id, d.text, d.lang, d.source, d.n_chars) for d in prose]
    rows += [(900, None, None, None, None), (901, "", "en", None, 0), (902, " \n", "en", "src1", 2), (None, rows[3][1] + " and more", "en", None, 9), (None, "no id, but prose of some words", None, "src0", 30), rows[5], rows[5], (903, rows[2][1], "fr", "src9", 1)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for empty in (True, False):
        x = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            x = written(stage(spark, x, SF), f"test-{name}")
            if name != "shard":
                assert x.columns == docs.columns
        assert x.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and (x.count() == 0) == empty
