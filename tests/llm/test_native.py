import random
import re
from collections import Counter

from linkspan.llm import mixing as M
from linkspan.llm import quality_rules as Q


def brute_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_measures_against_plain_python(spark, tricky, empty):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["a", "b", "c", "dé", "e\n", "|", "f#"]) for _ in range(draw.randrange(90))) for _ in range(60)]
    texts += [" ".join(f"w{draw.randrange(300)}" for _ in range(200)) for _ in range(20)] + [r.text for r in tricky.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in Q.measures(docs).collect():
        assert tuple(r[n] for n in NAMES) == brute_base(texts[r.doc_id]), texts[r.doc_id]
    assert Q.measures(empty).count() == 0


def test_windows_whose_hashes_clash_are_compared_by_words(spark):
    from pyspark.sql import functions as F

    draw = random.Random(7)
    texts = [" ".join(draw.choice(["a", "b", "c", "dé", "e"]) for _ in range(draw.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("w", F.array_remove(F.split("text", " "), ""))
    for clash in (lambda *w: F.lit(-7).cast("bigint"), lambda *w: F.xxhash64(*w[:1]), lambda *w: F.shiftleft(F.xxhash64(*w), 60)):
        for r in docs.withColumn("n", F.size("w")).withColumn("got", Q._repeat_words(F.col("w"), F.col("n"), clash)).collect():
            assert r.got == brute_base(r.text)[4], r.text


def test_line_rules(spark):
    bad = ["Inicio » Noticias » Contacto", "Start › Hilfe › Kontakt", "und so weiter ...", "Leer más…", "Alle Rechte vorbehalten", "Lire la suite", "Tous droits réservés.", "AVISO LEGAL", "$$$ cheap ###"]
    good = ["Das Haus ist alt.", "La casa es vieja, y el perro también.", "He waited ... and then left.", "Zimmer 3 · Küche ist frei und sehr schön gelegen am Rande der Stadt"]
    rows = spark.createDataFrame([(x,) for x in bad + good], "x string")
    from pyspark.sql import functions as F

    assert {r.x for r in rows.where(Q.line_passes(F.col("x"))).collect()} == set(good)


def test_lines_are_cleaned_and_documents_judged(spark):
    good = [" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8)]
    bad = ["Home | News | About | Contact", "BUY!! NOW!! CHEAP!! STUFF!!", "### *** $$$ %%% &&&", "Click here to subscribe", "THIS LINE IS SHOUTED AT YOU", good[0]]
    docs = spark.createDataFrame([(1, "\n".join(good + bad)), (2, "\n".join(bad * 30)), (3, "\n".join(good)), (4, None)], "doc_id bigint, text string")
    kept = {r.doc_id: r.text for r in Q.clean(docs).collect()}
    assert kept == {1: "\n".join(good), 3: "\n".join(good)}


def test_clean_keeps_clashing_columns(tricky):
    assert Q.clean(tricky).columns == tricky.columns


def brute_targets(sources):
    names = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + ([None] if None in sources else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sources.values()), set()
    while True:
        left = total - sum(2 * sources[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sources[s] * (1 + 1e-12)}
        if not over:
            return {s: 2.0 * sources[s] if s in capped else share[s] for s in names}
        capped |= over


def test_targets_against_resharing(spark):
    draw = random.Random(5)
    for sources in (3, 7, 20):
        size = {f"s{k}": draw.choice([0, 1, 10, 100, 1000, 5000]) for k in range(sources)} | {None: 77}
        units = spark.createDataFrame([(i, s, n, i) for i, (s, n) in enumerate(size.items())], "doc_id bigint, source string, size bigint, tie bigint")
        got = {r.source: r.target for r in M.targets(units).collect()}
        want = brute_targets(size)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), (got, want)


def test_rounding_keeps_targets_and_bounds(spark):
    rows = [(i, "word " * (1 + i * 7 % 40), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    units = M.sizes(docs)
    goals = M.targets(units)
    got = M.decisions(units, goals, fan_in=8).collect()
    again = M.decisions(M.sizes(docs.repartition(3)), goals, fan_in=8).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    assert sorted(r.doc_id for r in got) == list(range(3000))
    goal = {r.source: r for r in goals.collect()}
    for source, g in goal.items():
        wanted = g.target / g.source_size
        mine = [r for r in got if r.source == source]
        assert all(int(wanted) <= r.copies <= int(wanted) + 1 for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - g.target) <= 20.5


def test_expectation_of_each_document(spark):
    rows = [(k * 10 + i, f"s{k}", 3 + i, k) for k in range(300) for i in range(6)]
    units = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, tie bigint")
    total = Counter()
    for r in M.decisions(units, M.targets(units, share=0.4, weights=(1,))).collect():
        total[r.doc_id % 10] += r.copies
    assert all(abs(total[i] / 300 - 0.4) < 0.12 for i in range(6)), total


def test_hot_rows_are_numbered_in_blocks(spark, monkeypatch):
    rows = [(1, "a", 3, 9000)] * 700 + [(i, "a", 5, i) for i in range(2, 300)] + [(None, None, 2, 5000)] * 50
    units = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, tie bigint").repartition(5)
    plain = sorted(map(tuple, M._numbered(units).select("tie", "copy").collect()))
    assert plain == sorted([(9000, k) for k in range(700)] + [(i, 0) for i in range(2, 300)] + [(5000, k) for k in range(50)])
    goals = M.targets(units)
    want = sorted((r.tie, r.copies) for r in M.decisions(units, goals, fan_in=16).collect())
    monkeypatch.setattr(M, "SAME_ROWS", 64)
    assert sorted(map(tuple, M._numbered(units).select("tie", "copy").collect())) == plain
    assert sorted((r.tie, r.copies) for r in M.decisions(units.repartition(2), goals, fan_in=16).collect()) == want
    assert len(want) == len(rows)
    taken = sum(c * (3 if t == 9000 else 5) for t, c in want if t != 5000)
    assert abs(taken - next(g.target for g in goals.collect() if g.source == "a")) <= 2.5


def test_mix_on_tricky_rows(spark, tricky, empty):
    out = M.mix(tricky)
    assert out.columns == tricky.columns
    units = M.sizes(tricky)
    taken = M.decisions(units, M.targets(units)).collect()
    assert len(taken) == tricky.count()
    assert out.count() == sum(r.copies for r in taken)
    assert M.mix(empty).count() == 0
    hot = spark.createDataFrame([(1, "one two three", "a")] * 500, "doc_id bigint, text string, source string")
    assert abs(M.mix(hot).count() - 750) <= 1
