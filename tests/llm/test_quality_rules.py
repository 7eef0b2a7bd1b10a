import re
from collections import Counter

from surfacelab.llm import quality_rules as q

TEXTS = [None, "", " \n\t ", "a b c", "a b c a b c", "one two three four\none two three four\n\n x", "x " * 5000, "\x0b\x0cq #*$", "é ü ñ z", "a a a a", "l\nl\nl\n \nm"]


def brute(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def rows(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b c", "clash")], "doc_id long, text string, n_words string")


def test_measures_equal_brute_force(spark):
    got = q.quality_rules(rows(spark)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_exact_way_for_long_texts(spark, monkeypatch):
    monkeypatch.setattr(q, "PLACE_BITS", 2)
    for r in q.quality_rules(rows(spark)).collect():
        assert r.n_repeat_words == brute(r.text)[4]


def test_empty_table_and_custom_rules(spark):
    assert q.quality_rules(rows(spark).limit(0)).count() == 0
    good = spark.createDataFrame([(1, "the cat and dog of it was " * 2 + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert q.quality_rules(good).first().kept
    assert q.quality_rules(good, (q.Rule("short", "n_words", None, None, 10),)).first().failed_rules == ["short"]


def test_no_python_in_the_plan(spark):
    plan = q.quality_rules(rows(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
