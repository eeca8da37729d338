import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import alike, corpus, shingles, split, targets_by_rounds

import corpus_pipeline
from tidemark.llm import packing, quality_model


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after every stage, on documents with copies, edited copies, shared passages, nulls and empty texts."""
    top = tmp_path_factory.mktemp("corpus")
    texts = [*corpus(3, 150), *("## ** $$ || " * (k % 9 + 3) for k in range(40))]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(i < len(texts) - 40), 0) for i in range(0, len(texts), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    docs, out = spark.read.parquet(f"{top}/documents.parquet"), {}
    out["documents"] = docs.orderBy("doc_id").collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(top))
        assert name == "packing" or made.columns == docs.columns
        made.write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out[name] = docs.collect() if name == "packing" else docs.orderBy("doc_id", "text").collect()
    out["run"] = corpus_pipeline.run(spark, str(top)).collect()
    return out


def test_quality_keeps_what_the_model_scores_high(spark, stages):
    x = {r.doc_id: quality_model.features(r.text) for r in stages["documents"]}
    n = len(x)
    picked = [i for i in range(0, n, 2) if zlib.crc32(str(i).encode()) % 5]
    rows = sorted((int(i < n - 40), x[i]) for i in picked)
    model = quality_model.train(np.array([r[1] for r in rows]), np.array([float(r[0]) for r in rows]))
    want = [r for r in stages["documents"] if model.score(np.array([x[r.doc_id]]))[0] >= corpus_pipeline.LEAST_QUALITY]
    assert stages["quality"] == want and 0 < len(want) < n
    assert sum(r.doc_id >= n - 40 for r in want) <= 2  # junk goes


def test_lines_without_later_matches(stages):
    seen, want = [], []
    for r in stages["quality"]:
        kept, removed = [], 0
        for line in (r.text or "").split("\n"):
            s = shingles([w.lower() for w in split(line)])
            if s and any(alike(s, o) for o in seen):
                removed += 1
            else:
                kept.append(line)
            seen += [s] if s else []
        text = None if r.text is None else "\n".join(kept) if removed else r.text
        if not (removed and not split(text)):
            want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert sorted(map(tuple, stages["lines"]), key=lambda r: r[0]) == want and len(want) < len(stages["quality"])


def test_one_document_of_each_group(stages):
    rows = stages["lines"]
    sets, group = [shingles([w.lower() for w in split(r.text)]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and alike(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert stages["near_duplicates"] == [r for i, r in enumerate(rows) if group[i] == i]


def test_mixed_to_the_targets(stages):
    sizes, texts, taken = defaultdict(int), {}, defaultdict(int)
    for r in stages["near_duplicates"]:
        sizes[r.source] += len(split(r.text))
        texts[r.doc_id] = r.text
    for r in stages["mixing"]:
        taken[r.source] += len(split(r.text))
        assert r.text == texts[r.doc_id] or texts[r.doc_id].strip().startswith(r.text)
        assert r.n_chars == len(r.text)
    want = targets_by_rounds(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and max(Counter(r.doc_id for r in stages["mixing"]).values()) <= 2


def test_packed_and_run(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in stages["mixing"]:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] += len(ids)
    for rows in (stages["packing"], stages["run"]):
        got, per = Counter(), Counter()
        for p in rows:
            got[p.doc_id] += p.length
            per[p.sequence_id] += p.length
        assert got == want and all(n <= 4096 and n & (n - 1) == 0 for n in per.values())
