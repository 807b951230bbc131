import difflib
import random

import pytest

from quaero.operators import fuzzy


@pytest.mark.parametrize("cutoff", [0.84, 0.9])
def test_no_similar_word_is_missed(spark, cutoff):
    r = random.Random(5)
    words = {"".join(r.choice("abcde") for _ in range(r.randrange(2, 12))) for _ in range(500)} | {"aaaaaaaa", "aaaaaaa", "abababab", "bababab", "café", "cafe"}
    for w in list(words)[:200]:
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]} - {""}
    asked = [w for w in sorted(words) if len(w) >= 4][::7]
    table = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {(x.word, x.suggestion, round(x.ratio, 12)) for x in fuzzy.similar(table(asked), table(words), cutoff).collect()}
    want = set()
    for a in asked:
        matcher = difflib.SequenceMatcher(autojunk=False)
        matcher.set_seq2(a)
        for w in words:
            matcher.set_seq1(w)
            if w != a and (ratio := matcher.ratio()) >= cutoff:
                want.add((a, w, round(ratio, 12)))
    assert got == want and want


def test_suggestions_are_the_closest(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("fietsbrug", "fietsbruggen", "fietsbrugg", "brug", "trein", "fietsbrugge")], "word string")
    got = [(x.word, x.suggestion) for x in fuzzy.suggestions(vocabulary, ["fietsbrugg", "abc", "onbekend"]).collect()]
    assert sorted(got) == [("fietsbrugg", "fietsbrug"), ("fietsbrugg", "fietsbrugge")]
    assert fuzzy.suggestions(vocabulary, ["abc"]).count() == 0


def test_the_vocabulary_is_never_broadcast_and_longer_words_are_left_out(spark, tmp_path):
    words = [f"fietsbrug{i}" for i in range(50)] + ["fietsbrug", "ab" * 3000]
    spark.createDataFrame([(w,) for w in words], "word string").write.parquet(f"file://{tmp_path}/v")
    vocabulary = spark.read.parquet(f"file://{tmp_path}/v")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    few = fuzzy.suggestions(vocabulary, ["fietsbrugg"])
    many = fuzzy.similar(spark.createDataFrame([("fietsbrugg",)], "word string"), vocabulary)
    for found in (few, many):
        nodes, sent = [found._jdf.queryExecution().executedPlan().initialPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            sent += [node.output().mkString()] if node.nodeName() == "BroadcastExchange" else []
        assert not any("suggestion" in x for x in sent)
    assert [r.suggestion for r in few.collect()] == ["fietsbrug", "fietsbrug9"] and many.count() == 51
