"""Scoring, sandbox and judging flows, and the values that answers and markup must give."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.python_udfs import repaired
from plumbline.operators import agents, judging, retrieval, sandbox, scoring, testbeds
from plumbline.sources.scratch import dealt

RESULT = "line_no long, key string, config_id string, case_id string, generator_key string, final_answer string, raw_text string, error string, truncated boolean"
CASE = "case_id string, query string, answer string, dimension string, noise_ratio double, seed_id string"
ROW = f"case_id string, query string, answer string, passages array<{testbeds.PASSAGE}>"


@pytest.mark.parametrize(("needle", "text", "found"), [
    ("King George I", "King George III agreed", False), ("King George I", "succeeded by King George I in 1714", True), ("UK", "Slovakia and Ukraine", False), ("glycine", "N-methylglycine", False),
    ("1889", "It was completed in 1889", True), ("Bogota", "riots in Bogotá spread", True), ("Bogotá", "riots in Bogota spread", True), (" St. ", "in St. Ives", True), ("", "x", False), ("\tcafé\n", "CAFE, open", True), ("a\\Eb", "x a\\Eb y", True),
])
def test_word_boundaries(spark, needle, text, found):
    df = spark.createDataFrame([(needle, text)], "n string, t string")
    assert df.select(T.on_word_boundary(F.col("n"), F.col("t"))).first()[0] is found


@pytest.mark.parametrize(("source", "shown"), [
    ('<Table> <Tr> <Th colspan="2"> Swine flu </Th> </Tr> <Tr> <Th> Specialty </Th> <Td> Infectious disease </Td> </Tr> </Table>', '<table> <tr> <th colspan="2"> Swine flu </th> </tr> <tr> <th> Specialty </th> <td> Infectious disease </td> </tr> </table>'),
    ("<P> Beijing , China </P> <H2> Other notes </H2>", "<p> Beijing , China </p> <h2> Other notes </h2>"),
    ("Beijing . </P> <H2> Notes </H2>", "Beijing .  <h2> Notes </h2>"), ("<P> unterminated", "<p> unterminated</p>"), ("<Td> 1932 </Td>", "<table><tr><td> 1932 </td></tr></table>"),
    ("<Table> The Hunger Games <Tr> <Td> 2012 </Td> </Tr> </Table>", "<table><tr><td> The Hunger Games </td></tr><tr> <td> 2012 </td> </tr> </table>"),
    ("5 < 6 and <Script> x </Script> & <B> b </B>", "5 &lt; 6 and &lt;Script&gt; x &lt;/Script&gt; &amp; &lt;B&gt; b &lt;/B&gt;"),
    ('<Td style="x" colspan="3" onclick="evil()"> a </Td>', '<table><tr><td colspan="3"> a </td></tr></table>'), ("<p>a<p>b", "<p>a</p><p>b</p>"), ("<dt>a<dd>b<dt>c", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"), ("", ""),
])
def test_markup(source, shown):
    assert repaired(source) == shown


def test_deep_markup_is_linear():
    import time

    began = time.time()
    assert repaired("<ul><li>" * 100_000).endswith("</ul>")
    assert time.time() - began < 20


def results(spark, *rows):
    return spark.createDataFrame([(i, None, "naive|bm25|standard_1", c, "standard_1", f, r, e, t) for i, (c, f, r, e, t) in enumerate(rows)], RESULT)


def test_scoring_a_log(spark):
    cases = spark.createDataFrame([("a", "q", "Bogotá", "noise", 0.25, "s"), ("u", "q", T.NO_ANSWER, "refusal", None, "s"), ("r", "q", "1889", "conflict", None, "t")], CASE)
    long = "no mention of it anywhere in these passages, but I would guess that the year was eighteen eighty nine or so"
    log = results(spark, ("a", "x", "", "timeout", None), ("a", "It is Bogota", "", "", True), ("u", None, "INSUFFICIENT EVIDENCE", None, None), ("r", long, "", None, None), ("gone", "x", "", None, None))
    new = scoring.newest_results(log)
    assert scoring.result_counts(log).first()[:] == (4, 1, 1) and scoring.result_counts(new).first()[:] == (4, 0, 1)
    got = {r.case_id: r for r in scoring.scored(new, cases).collect()}
    assert set(got) == {"a", "u", "r"}
    assert got["a"].answer_correct and not got["a"].exact_match and got["a"].token_f1 == pytest.approx(0.0) and got["a"].truncated and got["a"].noise_ratio == 0.25
    assert (got["u"].category, got["u"].recovery_method, got["u"].answer_correct, got["u"].is_answerable) == ("refusal", "bare_sentinel", None, False)
    assert (got["r"].category, got["r"].classification_method) == ("refusal", "rule_unconfident_no_fallback")
    key = "naive|bm25|standard_1::r"
    for text, error, method, category in (("Label: ANSWER", None, "llm_fallback", "answer"), ("ANSWER", "HTTP 500", "rule_unconfident_no_fallback", "refusal"), ("?", None, "rule_unconfident_no_fallback", "refusal")):
        reply = spark.createDataFrame([(key, text, error)], "key string, text string, error string")
        r = scoring.scored(new, cases, reply).filter("case_id = 'r'").first()
        assert (r.classification_method, r.category) == (method, category) and r.answer_correct == (False if category == "answer" else None)
    failed = scoring.provider_errors(log, cases).collect()
    assert [(r.case_id, r.category, r.answer_correct) for r in failed] == [("a", "unparseable", None)]
    assert scoring.scored(new.limit(0), cases).count() == 0


def boxes(spark):
    p = lambda i, bearing=False: (f"p{i}", f"text {i}", bearing, False)
    return spark.createDataFrame([("ok", "text 1", "1", [p(0, True), p(1)]), ("shut", "text 3", T.NO_ANSWER, [p(2), p(3)])], ROW)


def test_sandbox_order_and_guards(spark):
    pool = "case_id string, place int, passage_id string, text string, is_answer_bearing boolean, is_injected boolean"
    cases = boxes(spark)
    good = spark.createDataFrame([("ok", 2, "d2", "far", False, True), ("ok", 1, "d1", "text 1 text 1", None, True), ("nobody", 1, "x", "x", False, True)], pool)
    box = sandbox.built(cases, good)
    assert [(r.idx, r.is_case, r.passage_id) for r in box.filter("case_id = 'ok'").orderBy("idx").collect()] == [(0, True, "p0"), (1, True, "p1"), (2, False, "d1"), (3, False, "d2")]
    assert sandbox.asserted(box, cases).count() == 6 and sandbox.leaks(box, cases).count() == 0
    with pytest.raises(Exception, match="answer-bearing"):
        sandbox.built(cases, spark.createDataFrame([("ok", 1, "d1", "t", True, True)], pool)).collect()
    leaky = box.withColumn("is_answer_bearing", F.col("passage_id") == "p3")
    assert [tuple(r) for r in sandbox.leaks(leaky, cases).collect()] == [("shut", "p3")]
    with pytest.raises(Exception, match="unanswerable"):
        sandbox.asserted(leaky, cases).collect()
    scored = sandbox.scores(box, cases)
    top = sandbox.retrieved(scored, 2).filter("case_id = 'ok'").orderBy("rank").collect()
    own = sandbox.ranked_case_passages(scored).filter("case_id = 'ok'").orderBy("rank").collect()
    every = sorted((-r.score, r.idx, r.passage_id) for r in scored.filter("case_id = 'ok'").collect())
    assert [r.passage_id for r in top] == [x[2] for x in every[:2]] and [r.passage_id for r in own] == [x[2] for x in every if x[2][0] == "p"] and len(every) == 4


def test_live_judge_scores(spark):
    scored = spark.createDataFrame([("c1", "a", 3), ("c2", "b", 4), ("c1", "b", None)], "config_id string, case_id string, crs_score int")
    sheet = judging.numbered(scored.filter("crs_score IS NOT NULL"), "config_id")
    ratings = judging.rating_sheet(sheet).withColumn("your_score_0_to_4", F.when(F.col("item") == 1, " 3 ").otherwise(""))
    old = judging.judge_sheet(sheet).withColumn("judge_score", F.lit(3))
    pairs = judging.live_judge_pairs(ratings, old, scored)
    assert sorted(map(tuple, pairs.collect())) == [(1, 3, 3, False), (2, None, 4, True)] and judging.judge_counts(pairs).first()[:] == (2, 1, 1, 1)


def test_agents_by_hand(spark):
    """One case of each way through the loop."""
    from plumbline.operators import agents

    names = ["commits", "asks", "spins", "blank", "breaks", "later"]
    cases = spark.createDataFrame([(n, f"q {n}", "x", [(f"{n}{i}", f"text {i} {n}", False, False) for i in range(4)]) for n in names], ROW)
    box = sandbox.built(cases)
    prompts = []

    def ask(requests):
        prompts.append({r.key: r.prompt for r in requests.collect()})
        k, p = F.col("key"), F.col("prompt")
        text = (
            F.when(p.startswith("D"), F.when(k == "blank", " ").when(k == "commits", "1. text 1").otherwise("text 1\ntext 2"))
            .when(p.startswith("Y"), "<final_answer>forced</final_answer>")
            .when(k == "commits", "<final_answer>one</final_answer>").when((k == "asks") & p.contains("left 2"), "NEXT_QUERY: text 3").when((k == "asks") & p.contains("left 0"), "<final_answer>three</final_answer>").when(k == "blank", "hm").otherwise("go on")
        )
        error = F.when((k == "breaks") & p.startswith("D"), "HTTP 500").when((k == "later") & p.contains("left 1"), "HTTP 429")
        return requests.select("key", text.alias("text"), error.alias("error"), ((k == "spins") & p.startswith("Y")).alias("truncated"))

    got = {r.case_id: r for r in agents.agentic(cases, box, ask, {"decompose": "D {question} {most}", "step": "S {question} left {remaining}\n{evidence}", "synthesise": "Y {question}\n{evidence}"}, max_steps=3, k=2).collect()}
    nodes = {n: [s.node for s in got[n].steps] for n in names}
    assert got["commits"].final_answer == "one" and got["commits"].generator_calls == 2 and nodes["commits"] == ["decompose", "retrieve", "react"]
    assert [s["query"] for s in got["asks"].steps if s.node == "retrieve"] == ["text 1", "text 3", "text 2"] and got["asks"].final_answer == "three" and not got["asks"].warnings
    assert got["spins"].final_answer == "forced" and got["spins"].truncated and got["spins"].generator_calls == 4 and nodes["spins"][-1] == "synthesise"
    assert got["blank"].final_answer == "forced" and got["blank"].steps[0].subqueries == ["q blank"] and len(got["blank"].warnings) == 2 and nodes["blank"] == ["decompose", "retrieve", "react", "synthesise"]
    assert got["breaks"].error == "decompose: HTTP 500" and got["breaks"].generator_calls == 1 and got["breaks"].steps == [] and got["later"].error == "react step 1: HTTP 429"
    assert len(got["asks"].retrieved_passage_ids) == len(set(got["asks"].retrieved_passage_ids)) >= 2 and len(prompts) == 5


def test_scoring_moves_texts_and_not_their_words(spark):
    """A group's passages meet its query as texts: nothing but a query's words is dealt by word, and a sandbox that is dealt by case stays where it is."""
    rows = spark.createDataFrame([(f"c{i // 3}", i % 3, True, f"p{i}", f"a b{i} c c{i % 5}", False, False) for i in range(30)], "case_id string, idx long, is_case boolean, passage_id string, text string, is_answer_bearing boolean, is_injected boolean")
    asked = spark.createDataFrame([(f"c{i}", f"b{3 * i} c") for i in range(9)], "case_id string, query string")
    by_word = re.compile(r"Exchange hashpartitioning\(case_id#\d+, term#\d+")
    plain = retrieval.bm25(rows, asked, "case_id", "passage_id", "idx")
    assert len(by_word.findall(plain._jdf.queryExecution().executedPlan().toString())) == 1
    box = dealt(rows, "case_id", "boxes")
    found = sandbox.scores(box, asked, sandbox.indexed(box, there=True))
    assert {(x.passage_id, round(x.score, 9)) for x in found.collect()} == {(x.passage_id, round(x.score, 9)) for x in plain.collect()} and found.count() == 30
    texts = box.groupBy("case_id").agg(F.max("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in texts and "text" not in agents.EVIDENCE
