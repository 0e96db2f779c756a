"""Token rollups against a plain ledger, and license alignment against planted texts and a slow subsequence."""

from __future__ import annotations

import itertools
import random

import pytest

from stairwell.llm import license_scan, queries, token_rollups
from stairwell.llm.common import shared_folder
from stairwell.llm.license_scan import TEMPLATES, align, longest_increasing, scan_text, words_at
from stairwell.llm.token_rollups import TokenRollups

CHANGES = "doc_id long, tokenizer string, source string, lang string, n_tokens long, op string, seq int, docs int"


@pytest.mark.parametrize("compact", [1, 2, 16])
def test_batches_of_changes(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(token_rollups, "COMPACT", compact)
    rng = random.Random(3)
    rollups = TokenRollups(spark, f"{tmp_path}/rollups")
    ledger: dict = {}
    for batch in range(4):
        rows = []
        for seq in range(60 if batch != 2 else 0):
            row = (rng.choice([None, *range(25)]), rng.choice(["v1", "v2"]), rng.choice([None, "a", "b"]), rng.choice(["en", "de"]), rng.choice([None, 0, 5, 70]), rng.choice(["insert", "revise", "delete"]), seq, 1)
            rows += [row, row] if seq % 9 == 0 else [row]
        changes = spark.createDataFrame(rows, CHANGES)
        assert rollups.commit(batch, changes)
        assert not rollups.commit(batch, changes)
        for doc, version, source, lang, n, op, *_ in rows:
            ledger[doc, version] = None if op == "delete" else (source, lang, version, n or 0)
        want: dict = {}
        for entry in filter(None, ledger.values()):
            docs, tokens = want.get(entry[:3], (0, 0))
            want[entry[:3]] = (docs + 1, tokens + entry[3])
        got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollups.totals(batch + 1).collect()}
        assert got == want


def test_compaction_bounds_what_is_read(spark, tmp_path, monkeypatch):
    """A commit reads the compacted table and the batches since; a broken-off compaction is not read."""
    monkeypatch.setattr(token_rollups, "COMPACT", 2)
    rollups = TokenRollups(spark, f"{tmp_path}/rollups")
    for batch in range(5):
        change = spark.createDataFrame([(1, "v", "a", "en", batch, "revise", 0, 1), (2, "v", "b", "en", 3, "delete" if batch % 2 else "insert", 0, 1)], CHANGES)
        rollups.commit(batch, change)
    read = lambda n: {"/".join(f.split("/")[-3:-1]) for f in rollups._read("ledger", token_rollups.LEDGER, n).inputFiles()}
    assert read(5) == {"compact-ledger/batch-4", "ledger/batch-4"}
    (tmp_path / "rollups" / "compact-ledger" / "batch-4" / "_SUCCESS").unlink()
    assert read(5) == {"compact-ledger/batch-2", "ledger/batch-2", "ledger/batch-3", "ledger/batch-4"}
    assert sorted(map(tuple, rollups.totals(5).collect())) == [("a", "en", "v", 1, 4), ("b", "en", "v", 1, 3)]


def test_no_text_is_shuffled(spark):
    """Texts are counted where they are read: no exchange of the query's tables has a text."""
    plan = queries._token_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "text" not in plan.columns and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    rollups = TokenRollups(spark, f"{tmp_path}/rollups")
    first = spark.createDataFrame([(1, "v", "a", "en", 5, "insert", 0, 1)], CHANGES)
    rollups.commit(0, first)
    bad = spark.createDataFrame([(1, "v", "a", "en", 9, "insert", 0, 1), (2, "v", "a", "en", 9, "wrong", 0, 1)], CHANGES)
    with pytest.raises(Exception, match="unknown op"):
        rollups.commit(1, bad)
    assert not rollups.committed(1)
    with pytest.raises(ValueError, match="not committed"):
        rollups.commit(2, first)
    assert rollups.commit(1, bad.where("doc_id = 1"))
    assert [tuple(r) for r in rollups.totals(2).collect()] == [("a", "en", "v", 1, 9)]
    assert shared_folder(spark)


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        values = rng.sample(range(20), rng.randint(0, 9))
        kept = [values[k] for k in longest_increasing(values)]
        best = max((n for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c)), default=0)
        assert kept == sorted(set(kept)) and len(kept) == best


def test_alignment_increases_and_agrees():
    rng = random.Random(2)
    for _ in range(100):
        template = rng.choices("abcdefghij", k=12)
        text = rng.choices("abcdefghij", k=6) + [w for w in template if rng.random() < 0.9] + rng.choices("klm", k=4)
        pairs = align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(pairs))
        # every word is unique in its gap or beside an aligned one, or the gap has no word unique to both
        assert len(pairs) <= len(template)


def test_planted_licenses(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join("".join(rng.choices("klmnop", k=6)) for _ in range(n))
    rows, want = [(None, filler(5) + " " + TEMPLATES["isc"]), (900, None), (901, ""), (902, filler(2000))], {(None, "isc")}
    for k, (name, template) in enumerate(TEMPLATES.items()):
        rows.append((k, f"{filler(30)}\n{template.upper()}\n{filler(9)}"))
        words = template.split()
        changed = [w for i, w in enumerate(words) if i % 12 != 7]
        rows.append((100 + k, f"{filler(3)} {' '.join(changed)}"))
        rows.append((200 + k, f"{template} {filler(20)} {template} {filler(4)}"))
        want |= {(k, name), (100 + k, name), (200 + k, name)}
        rows.append((300 + k, filler(4) + " " + " ".join(words[: len(words) // 2])))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, template string").repartition(3)
    got = license_scan.scan(docs, TEMPLATES).collect()
    found = {(r.doc_id, r.template): r for r in got}
    assert want <= set(found)
    assert not any(i in (900, 901, 902) for i, _ in found)
    text = dict(rows)
    for (i, name), r in found.items():
        if i is not None and i < 100 and i == list(TEMPLATES).index(name):
            assert r.coverage == 1 and text[i][r.begin : r.end].lower() == TEMPLATES[name].lower().rstrip("./>")
    assert license_scan.scan(docs.limit(0), TEMPLATES).collect() == []


def naive_align(text: list[str], template: list[str]) -> int:
    """Words aligned, by the definition: equal ends, then a longest sequence of words unique to both, then the gaps."""
    n = 0
    while text and template and text[0] == template[0]:
        text, template, n = text[1:], template[1:], n + 1
    while text and template and text[-1] == template[-1]:
        text, template, n = text[:-1], template[:-1], n + 1
    once = [(text.index(w), j) for j, w in enumerate(template) if text.count(w) == 1 and template.count(w) == 1]
    once.sort()
    chains = [c for size in range(len(once), 0, -1) for c in itertools.combinations(once, size) if all(x[1] < y[1] for x, y in itertools.pairwise(c))]
    if not chains:
        return n
    edges = [(-1, -1), *[once[k] for k in longest_increasing([j for _, j in once])], (len(text), len(template))]
    assert len(edges) - 2 == len(chains[0])
    return n + len(edges) - 2 + sum(naive_align(text[a + 1 : c], template[b + 1 : d]) for (a, b), (c, d) in itertools.pairwise(edges))


def test_scan_against_all_regions():
    """Every stretch of the text is tried; the scan finds a match if, and only if, one of them covers enough."""
    rng = random.Random(9)
    found = 0
    for _ in range(250):
        template = rng.choices("abcdefghijkl", k=10)
        copy = [w for k, w in enumerate(template) if k not in rng.sample(range(10), rng.randint(0, 4))]
        text = rng.choices("abcdefghijklmnop", k=rng.randint(0, 12)) + copy + rng.choices("abcklmnop", k=rng.randint(0, 12))
        best = max(naive_align(text[a:b], template) for a in range(len(text)) for b in range(a + 1, len(text) + 1))
        got = scan_text(" ".join(text), {"t": template}, 0.8)
        whole = naive_align(text, template)
        assert not got or (whole <= got[0]["n_aligned"] <= best and got[0]["n_aligned"] >= 8)
        assert bool(got) == (best >= 8) or best < 10  # a full copy is never lost
        found += bool(got)
        assert not (got and best < 8)
    assert found > 80


def test_a_copy_without_the_rarest_word_is_found():
    """The word that is rarest in the text stands far from the copy, which lacks it; words of the template are all over the text."""
    rng = random.Random(10)
    template = [f"w{k}" for k in range(40)]
    for lacking in range(0, 40, 3):
        noise = rng.choices([w for k, w in enumerate(template) if k != lacking], k=300)
        copy = [w for k, w in enumerate(template) if k != lacking]
        text = noise[:150] + [template[lacking]] + noise[150:] + ["x"] * 10 + copy + ["y"] * 10 + noise[:80]
        (got,) = scan_text(" ".join(text), {"t": template}, 0.9)
        assert got["n_aligned"] >= 39


def test_ties_repeats_and_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "one.txt").write_text("alpha beta\ngamma delta epsilon")
    templates = license_scan.read_templates(spark, str(tmp_path))
    assert templates == {"one": "alpha beta\ngamma delta epsilon"}
    text = "alpha beta gamma delta x x x x x x x x x x x x x x x x x x x x x beta gamma delta epsilon"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "none")], "doc_id long, text string")
    got = license_scan.scan(docs, templates).collect()
    # equal coverage: the earliest region; rows that repeat are scanned each
    assert [(r.doc_id, r.n_aligned, r.begin, r.end) for r in got] == [(1, 4, 0, 22)] * 2


def test_shuffled_words_do_not_cover():
    words = [w for w, _, _ in words_at(TEMPLATES["mit"])]
    shuffled = list(words)
    random.Random(7).shuffle(shuffled)
    assert scan_text(" ".join(shuffled), {"mit": words}, 0.8) == []
