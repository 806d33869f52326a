"""Further queries over the driver's tables: answers, records by data set, strict joins, rotations, estimates, ensembles
and reports. Texts that the tables lack, such as tags or options, are made from their columns in both languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import answers, correctness, prompts, times
from scorewright.functions import text as T
from scorewright.operators import alignment, breakdowns, ensembles, estimates, irt, overlap, replicas, retrieval, sampling
from scorewright.plans.catalogue import _DRAW, _HITS, _NORMAL, _SCORES, _hits, _scores, query, r6, table
from scorewright.streaming import upserts

_TAGGED = """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Start <think>' || text || '</think> End <think>x</think>' WHEN 1 THEN text || '</think> first</think>' || chr(9) || 'tail ' || chr(10)
    WHEN 2 THEN chr(10) || text ELSE 'a<think>' || text END AS t FROM documents)"""


@query(rf"""
    SELECT doc_id, md5(regexp_replace(CASE WHEN NOT contains(t, '<think>') AND contains(t, '</think>') THEN string_split(t, '</think>')[-1] ELSE regexp_replace(t, '(?s)<think>.*?</think>', '', 'g') END,
    '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) AS content FROM {_TAGGED}""")
def reasoning_removed(spark, d):
    docs, m = table(spark, d, "documents"), F.col("doc_id") % 4
    t = F.when(m == 0, F.concat(F.lit("Start <think>"), "text", F.lit("</think> End <think>x</think>"))).when(m == 1, F.concat("text", F.lit("</think> first</think>\ttail \n")))
    t = t.when(m == 2, F.concat(F.lit("\n"), "text")).otherwise(F.concat(F.lit("a<think>"), "text"))
    return docs.select("doc_id", F.md5(T.without_reasoning(t).cast("binary")).alias("content"))


@query(r"""
    SELECT o_orderkey, o_orderkey || '500' AS gold, CASE WHEN o_orderkey % 4 = 0 THEN 'NULL' WHEN o_orderkey % 4 = 1 THEN o_orderkey || '500.0' WHEN o_orderkey % 4 = 2 THEN '-7' ELSE o_orderkey || '500' END AS predicted,
    (o_orderkey % 4 IN (1, 3))::INTEGER AS hit FROM orders""")
def solution_answers(spark, d):
    k = F.col("o_orderkey").cast("string")
    gold = answers.solution_answer(F.concat(F.lit("12 and 13 make 25\n#### "), k, F.lit(",500")))
    m = F.col("o_orderkey") % 4
    said = F.when(m == 0, F.lit("no idea Question: 3")).when(m == 1, F.concat(F.lit("it is 4, so "), k, F.lit("500.0"))).when(m == 2, F.concat(k, F.lit("500 or -7"))).otherwise(F.concat(k, F.lit("500 Question: 8?")))
    p = answers.prediction_answer(said)
    return table(spark, d, "orders").select("o_orderkey", gold.alias("gold"), p.alias("predicted"), answers.same_number(p, gold).cast("int").alias("hit"))


@query("""
    WITH t AS (SELECT p_partkey, p_retailprice AS x, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1.5 ELSE NULL END AS y FROM part)
    SELECT p_partkey, CASE WHEN y IS NULL THEN 0 ELSE (abs(x - y) <= 0.01 * abs(y))::INTEGER END AS hit FROM t""")
def numeric_matches(spark, d):
    m = F.col("p_partkey") % 3
    price = F.col("p_retailprice")
    reference = F.when(m == 0, price.cast("string")).when(m == 1, (price * 1.5).cast("string")).otherwise("none")
    return table(spark, d, "part").select("p_partkey", answers.numeric_match(F.concat(F.lit("about "), price.cast("decimal(20,2)").cast("string"), F.lit(" all in all")), reference, 0.0, 0.01).cast("int").alias("hit"))


@query("""
    SELECT p_partkey, (p_partkey % 2 = 0 OR p_partkey % 3 = 0)::INTEGER AS hit FROM part""")
def exact_matches(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("The item "), F.col("p_partkey").cast("string")).alias("name"))
    refs = F.array(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("an  ITEM, "), F.lit("x"))).otherwise("other"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("item "), F.col("p_partkey").cast("string"))).otherwise("none"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.lit("a ITEM. so")).otherwise(F.col("name"))
    return p.select("p_partkey", answers.exact_match(said, refs).cast("int").alias("hit"))


@query(r"""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(p_brand) END AS free, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE contains(lower(p_name), lower(p_brand)) OR contains(lower(p_brand), lower(p_name)) END AS alike,
    (lower(p_type) = lower(p_name) OR (length(p_brand) <= 10 AND p_partkey % 2 = 0))::INTEGER AS at_end FROM part""")
def free_text_matches(spark, d):
    m = F.col("p_partkey") % 3
    boxed = F.when(m == 0, " . ").otherwise(F.concat(F.lit(" \\boxed{"), "p_brand", F.lit("} !")))
    alike = answers.similar_text(F.when(m == 0, "").otherwise(F.col("p_name")), F.concat(F.lit("\t"), "p_brand", F.lit("\n")))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("it is "), F.upper("p_brand"), F.lit("."))).otherwise("nothing at all")
    return table(spark, d, "part").select("p_partkey", answers.free_text(boxed).alias("free"), alike.alias("alike"), answers.near_the_end(said, F.col("p_brand")).cast("int").alias("at_end"))


_JUDGED = ("正 确", "错误的", "未尝试", "It is not correct?", "maybe", "Y", "incorrect", "是不正确 correct", " ")
_FLAGS = (1, 0, 0, 1, None, 1, 0, 0, None)


@query("SELECT event_id, list_extract([1, 0, 0, 1, NULL, 1, 0, 0, NULL], (event_id % 9)::INTEGER + 1)::INTEGER AS flag FROM events")
def judge_flags(spark, d):
    said = F.element_at(F.array(*map(F.lit, _JUDGED)), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", answers.judge_flag(said).alias("flag"))


@query("""
    WITH t AS (SELECT o_orderkey, substr('ABCD', (o_orderkey % 4)::INTEGER + 1, 1) AS x FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE x END AS option, CASE WHEN o_orderkey % 6 IN (3, 5) THEN '' ELSE x END AS strict FROM t""")
def first_options(spark, d):
    x = F.substring(F.lit("ABCD"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))
    m = F.col("o_orderkey") % 6
    said = F.when(m == 0, F.concat(F.lit("答案是 "), x)).when(m == 1, F.concat(F.lit("well\nThe answer is: ("), x, F.lit(") b"))).when(m == 2, F.concat(F.lit("I say\nanswer : "), x, F.lit("\nbye")))
    said = said.when(m == 3, F.concat(F.lit("is-"), x, F.lit("-it"))).when(m == 4, F.concat(x, F.lit(" 选项"))).otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", answers.first_option(said).alias("option"), answers.first_option(said, cushion=False).alias("strict"))


@query("""
    WITH t AS (SELECT o_orderkey, substr('ABCDE', (o_orderkey % 5)::INTEGER + 1, 1) AS x FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE x END AS letter, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE x END AS capital FROM t""")
def letters_after_prefixes(spark, d):
    x = F.substring(F.lit("ABCDE"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(1))
    m = F.col("o_orderkey") % 3
    said = F.when(m == 0, F.concat(F.lit("The best answer is ("), x, F.lit(")"))).when(m == 1, F.concat(F.lit("Option:"), x)).otherwise("we can not say which of the many given ones it may be")
    return table(spark, d, "orders").select("o_orderkey", answers.letter_after_prefix(said).alias("letter"), T.empty_null(T.last_capital(F.when(m == 2, "no").otherwise(F.concat(F.lit("T "), x)))).alias("capital"))


@query("""
    SELECT o_orderkey, o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AS inside, o_orderkey % 2 = 0 AS same_day, o_orderkey % 3 = 0 AS same_span, (o_orderkey % 7)::INTEGER AS days FROM orders""")
def date_checks(spark, d):
    day = F.col("o_orderdate").cast("timestamp")
    other = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise("1/2/1803")
    k = F.col("o_orderkey") % 7
    truth = F.concat(F.lit("(11 weeks, "), k.cast("string"), F.lit(" days)"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("('11', '"), k.cast("string"), F.lit("')"))).when(F.col("o_orderkey") % 3 == 1, "long").otherwise("12 weeks 9 days")
    return table(spark, d, "orders").select("o_orderkey", times.within_dates(day, "1995-01-01", "1996-12-31").alias("inside"), times.same_date(F.date_format(day, "M/d/yyyy"), other).alias("same_day"), times.same_span(said, truth).alias("same_span"), times.weeks_and_days(truth)["days"].alias("days"))


@query("""
    WITH t AS (SELECT event_id, value * 60 AS s FROM events)
    SELECT event_id, round_even(event_id / 24.0, 4)::DOUBLE AS at, CASE WHEN s / 60.0 > 60 THEN '60+' ELSE '(' || (greatest(ceil(s / 60.0 / 10), 1) - 1)::INTEGER * 10 || ', ' || greatest(ceil(s / 60.0 / 10), 1)::INTEGER * 10 || ']' END AS bucket FROM t""")
def film_times(spark, d):
    return table(spark, d, "events").select("event_id", times.frame_time(F.col("event_id"), F.lit(24.0)).alias("at"), times.length_bucket(times.seconds(F.col("value") * 60 * 1000)).alias("bucket"))


def _record(**fields):
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1 WHEN o_orderkey % 5 = 1 THEN 0 WHEN o_orderkey % 5 = 2 THEN 1 WHEN o_orderkey % 5 = 3 THEN 0 ELSE NULL END AS explicit,
    CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE NULL END AS trusted FROM orders""")
def record_verdicts(spark, d):
    m = F.col("o_orderkey") % 5
    record = F.when(m == 0, _record(is_correct=F.array(F.lit("Yes"), F.lit("no")), hit=F.lit(0))).when(m == 1, _record(any_correct=F.lit(0.0), is_correct=F.lit(0.7)))
    record = record.when(m == 2, _record(binary_is_correct=F.lit(True), Is_Correct=F.lit(1))).when(m == 3, _record(if_right=F.lit("FAILED"))).otherwise(_record(score=F.lit(1)))
    rule = lambda n: correctness.dataset_correctness(record, n)
    return table(spark, d, "orders").select("o_orderkey", rule("SWE-bench_verified").alias("explicit"), rule("ocrbench_v2").alias("trusted"))


@query("""
    SELECT p_partkey, (p_partkey % 4 IN (0, 3))::INTEGER AS numbers, CASE p_partkey % 4 WHEN 3 THEN 1 WHEN 0 THEN contains(p_type, p_brand)::INTEGER ELSE NULL END AS counted FROM part""")
def record_numbers(spark, d):
    m, price = F.col("p_partkey") % 4, F.col("p_retailprice").cast("string")
    latex = F.concat(F.lit("so $"), price, F.lit(" \\times 10^{14}$"))
    record = F.when(m == 0, _record(prediction=latex, references=F.array(price))).when(m == 1, _record(prediction=F.lit("12"), answer=F.lit("13.5")))
    record = record.when(m == 2, _record(prediction=F.lit("Left"), gold=F.lit("right"))).otherwise(_record(prediction=F.lit(" \\boxed{Left}."), gold=F.lit("left")))
    counted = F.when(m == 0, _record(prediction=F.col("p_type"), answer=F.col("p_brand"))).when(m == 3, _record(prediction=F.lit("there are 7 of them"), answer=F.lit("7"))).otherwise(_record(prediction=F.lit("x")))
    return table(spark, d, "part").select("p_partkey", correctness.dataset_correctness(record, "scibench").alias("numbers"), correctness.dataset_correctness(counted, "countbenchqa").alias("counted"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN (floor(l_quantity) = 24)::INTEGER WHEN 2 THEN (l_tax = 0.02)::INTEGER WHEN 3 THEN 0 ELSE 1 END AS hit,
    (l_linenumber % 3 = 0)::INTEGER AS simple, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS judged FROM lineitem""")
def record_answers(spark, d):
    m, n = F.col("l_linenumber") % 5, F.col("l_linenumber")
    record = F.when(m == 0, _record(question_type=F.lit("multi_choice"), res=F.lit("it is (b) here"), answer_option=F.lit("B"))).when(m == 1, _record(answer_type=F.lit("integer"), prediction=(F.col("l_quantity") + 0.4).cast("string"), answer=F.lit("24")))
    record = record.when(m == 2, _record(answer_type=F.lit("float"), res=F.col("l_tax").cast("string"), answer=F.lit("2e-2"))).when(m == 3, _record(answer_type=F.lit("integer"), res=F.lit("two"), answer=F.lit("2"))).otherwise(_record(res=F.lit("A  red CAR"), answer=F.lit("red car")))
    simple = F.when(n % 3 == 0, _record(prediction=F.lit("(A) yes"))).when(n % 3 == 1, _record(prediction=F.lit("b"))).otherwise(_record(prediction=F.lit("none of these")))
    judged = F.when(n % 2 == 0, _record(judge_res=F.struct(F.lit("正确").alias("model_response")))).otherwise(_record(judge_res=F.lit("未尝试")))
    rule = correctness.dataset_correctness
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rule(record, "MathVista_mini").alias("hit"), rule(simple, "simpleqa").alias("simple"), rule(judged, "simplevqa").alias("judged"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.5 WHEN p_size % 3 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS counted, (p_size % 3 <> 1)::INTEGER::DOUBLE AS found, round(CASE WHEN p_size % 2 = 0 THEN 1.0 / 2 ELSE 0 END, 6)::DOUBLE AS class, (p_size % 2)::DOUBLE AS any_of FROM part""")
def item_metrics(spark, d):
    s = F.col("p_size")
    said = F.when(s % 3 == 0, "3 or 4").when(s % 3 == 1, "none").otherwise("3 3")
    ref = F.when(s % 3 == 0, "Paragraph 3").otherwise("Paragraph 3 and more")
    found = F.when(answers.retrieval_share(said, ref) > 0, 1.0).otherwise(0.0)
    classes = F.array(*map(F.lit, ("red wine", "wine", "beer")))
    named = answers.class_share(F.when(s % 2 == 0, "red wine or beer").otherwise("beer"), F.lit("red wine"), classes)
    return table(spark, d, "part").select("p_partkey", answers.count_share(said, F.lit("3")).alias("counted"), found.alias("found"), r6(named).alias("class"), T.contains_any(F.when(s % 2 == 1, "A RED thing").otherwise("blue"), F.array(F.lit("Red"), F.lit("green"))).alias("any_of"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE round((1.0 * p_size / 100) * 200, 6) END AS x1, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 1.0 ELSE 0.0 END AS inside FROM part""")
def boxes_in_pixels(spark, d):
    s = F.col("p_size")
    at = (s / 100).cast("string")
    said = F.when(s % 3 == 0, "no box").when(s % 3 == 1, F.concat(F.lit("["), at, F.lit(", 0.1, 0.9, 0.9]"))).otherwise(F.concat(F.lit("("), (s * 10).cast("string"), F.lit(",100), (900,900)")))
    box = answers.scaled_box(answers.boxes(said), F.lit(200.0), F.lit(100.0))
    other = F.when(s % 3 == 1, box).otherwise(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(1001.0), F.lit(1001.0)))
    return table(spark, d, "part").select("p_partkey", r6(F.element_at(box, 1)).alias("x1"), F.when(box.isNotNull(), F.when(T.box_iou(box, other) >= 0.5, 1.0).otherwise(0.0)).alias("inside"))


# --- strict joins and orders --------------------------------------------------------------------------


@query("SELECT p_partkey AS \"index\", p_name AS id, p_size::DOUBLE AS weight, (1000000 - p_partkey)::BIGINT AS place FROM part WHERE p_partkey % 4 = 0")
def subset_by_position(spark, d):
    p = table(spark, d, "part")
    data = p.select(F.col("p_partkey").alias("index"), F.col("p_name").alias("id"))
    spec = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("id"), F.col("p_size").cast("double").alias("weight"), (1000000 - F.col("p_partkey")).alias("place"))
    return alignment.select_by_position(data, spec).select("index", "id", "weight", "place")


@query("SELECT p_partkey AS \"index\", p_brand, p_size::DOUBLE AS weight FROM part WHERE p_partkey % 4 = 0")
def subset_by_value(spark, d):
    spec = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("index"), F.col("p_size").cast("double").alias("weight"))
    return alignment.select_by_value(table(spark, d, "part").select(F.col("p_partkey").alias("index"), "p_brand"), spec)


@query("SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS weight, o_orderstatus FROM orders")
def weights_and_references(spark, d):
    o = table(spark, d, "orders")
    scored = alignment.attach_weights(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", F.col("o_custkey").cast("double").alias("weight")), "o_orderkey")
    return alignment.zipped(scored, o.select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_orderkey", "o_totalprice", "weight", "o_orderstatus")


@query("""
    WITH a AS (SELECT l_suppkey, round(avg(l_tax), 6) AS tax FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_suppkey, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_linenumber = 2 GROUP BY 1), c AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS quantity FROM lineitem WHERE l_linenumber = 5 GROUP BY 1)
    SELECT l_suppkey, tax, discount, quantity FROM a JOIN b USING (l_suppkey) JOIN c USING (l_suppkey)""")
def side_by_side_scores(spark, d):
    rows = table(spark, d, "lineitem")
    parts = [rows.where(F.col("l_linenumber") == n).groupBy("l_suppkey").agg(r6(F.avg(c)).alias(a)) for n, c, a in ((1, "l_tax", "tax"), (2, "l_discount", "discount"), (5, "l_quantity", "quantity"))]
    return alignment.joined_scores(parts, "l_suppkey")


@query("""
    SELECT p_brand, event_type, a::BIGINT AS brand_order, first_position, g::BIGINT AS group_order FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS a FROM (SELECT DISTINCT p_brand FROM part)) x
    FULL JOIN (SELECT event_type, min(event_id) AS first_position, row_number() OVER (ORDER BY min(event_id)) - 1 AS g FROM events GROUP BY 1) y ON a = g""")
def orders_of_ids(spark, d):
    brands = alignment.id_order(table(spark, d, "part").select("p_brand").distinct(), "p_brand").withColumnRenamed("item_order", "brand_order")
    seen = alignment.first_seen_order(table(spark, d, "events"), "event_type", "event_id")
    return brands.join(seen, F.col("brand_order") == F.col("group_order"), "full_outer").select("p_brand", "event_type", "brand_order", "first_position", "group_order")


@query("SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS item_order FROM nation")
def numbers_in_order(spark, d):
    return alignment.id_order(table(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query("""
    SELECT (2 * s_suppkey + 1 + k)::BIGINT AS "index", s_suppkey / 2.0::DOUBLE AS weight FROM supplier CROSS JOIN (SELECT unnest([0, 1]) AS k)""")
def unfolded_pairs(spark, d):
    spec = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pair"), F.col("s_suppkey").cast("double").alias("weight"))
    return alignment.unfold_pairs(spec)


@query("""
    SELECT p_partkey, k::INTEGER AS step, p_partkey || '.' || k AS sub_id, list_extract(string_split(p_type, ' '), k::BIGINT) AS body FROM part, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= len(string_split(p_type, ' ')) AND NOT (p_partkey % 5 = 0 AND k = 1)""")
def numbered_steps(spark, d):
    p = table(spark, d, "part")
    given = p.where("p_partkey % 5 = 0").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".1")).alias("sub_id"))
    return alignment.numbered_steps(p.select("p_partkey", F.split("p_type", " ").alias("steps")), "p_partkey", "steps", given)


@query("""
    WITH a AS (SELECT s_suppkey, abs(s_acctbal) / 100 AS accuracy FROM supplier)
    SELECT s_suppkey, round(accuracy, 6) AS accuracy FROM a WHERE CASE WHEN accuracy > 1 THEN accuracy / 100 ELSE accuracy END BETWEEN 0.2 AND 0.8 AND s_suppkey NOT IN (3, 5)""")
def model_filters(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 100).alias("accuracy"))
    return alignment.performance_band(alignment.named_models(s, "s_suppkey", exclude=("3", "5")), "accuracy", 0.2, 0.8).withColumn("accuracy", r6("accuracy"))


@query(f"""
    WITH e AS (SELECT event_id - (SELECT min(event_id) FROM events) AS pos FROM events), n AS (SELECT count(*) AS n, max(pos) + 1 AS m FROM e)
    SELECT 'slice' AS part, pos::BIGINT AS pos FROM e, n WHERE pos >= 10 AND pos < m - 20 UNION ALL (SELECT 'share', pos::BIGINT FROM e ORDER BY {_DRAW.format("'3:' || pos")}, pos LIMIT (SELECT (0.25 * n)::BIGINT FROM n))""")
def row_slices(spark, d):
    e = table(spark, d, "events")
    rows = e.crossJoin(F.broadcast(e.agg(F.min("event_id").alias("m")))).select((F.col("event_id") - F.col("m")).alias("pos"))
    part = lambda name, df: df.select(F.lit(name).alias("part"), "pos")
    return part("slice", alignment.row_slice(rows, "pos", "[10:-20]")).unionByName(part("share", alignment.row_slice(rows, "pos", 0.25, seed=3)))


# --- rotations and replicas ---------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS qid, p AS pattern, CASE o_orderkey % 5 WHEN 4 THEN 'none' ELSE substr(p, (o_orderkey % 5)::INTEGER + 1, 1) END AS answer,
    substr('wxyz', instr(p, 'A')::INTEGER, 1) || o_orderkey AS "A", substr('wxyz', instr(p, 'D')::INTEGER, 1) || o_orderkey AS "D" FROM orders, (SELECT unnest(['ABCD', 'BCDA', 'CDAB', 'DABC']) AS p)""")
def rotated_options(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", *[F.concat(F.lit(x), k.cast("string")).alias(o) for o, x in zip("ABCD", "wxyz")], F.when(k % 5 == 4, "none").otherwise(F.substring(F.lit("ABCD"), (k % 5 + 1).cast("int"), F.lit(1))).alias("answer"))
    return replicas.rotate_options(rows, "o_orderkey", "answer").select("qid", "pattern", "answer", "A", "D")


_ROTATED = """
    q AS (SELECT l_orderkey AS qid, list_extract(['ABCD', 'BCDA', 'CDAB', 'DABC'], (l_linenumber % 4)::BIGINT + 1) AS pattern, list_extract(['A', 'B', 'C', 'D', NULL], (l_partkey % 5)::BIGINT + 1) AS prediction, 'A' AS answer FROM lineitem),
    b AS (SELECT *, (coalesce(prediction, '') = answer)::INTEGER AS hit, pattern = 'ABCD' AS origin, CASE WHEN prediction IS NULL THEN '-' ELSE substr(pattern, instr('ABCD', prediction)::INTEGER, 1) END AS back, substr(pattern, 1, 1) AS truth FROM q),
    e AS (SELECT qid, sum(hit) AS h4, sum(CASE WHEN origin THEN hit ELSE 0 END) AS h1, count(*) AS n, min(truth) AS truth FROM b GROUP BY 1),
    v AS (SELECT qid, o, sum((back = o)::INTEGER) AS v4, sum((back = o AND origin)::INTEGER) AS v1, strpos('ABCD-', o) AS p FROM b, (SELECT unnest(['A', 'B', 'C', 'D', '-']) AS o) GROUP BY qid, o),
    w AS (SELECT qid, first(o ORDER BY v4 DESC, p) AS o4, first(o ORDER BY v1 DESC, p) AS o1 FROM v GROUP BY 1)"""


@query(f"""
    WITH {_ROTATED}, m AS (SELECT sum(h1) / sum(n) * 400 AS acc_1, sum(h4) / sum(n) * 100 AS acc_4, avg((h1 >= 1)::INTEGER) * 100 AS perf_1, avg((h4 >= 4)::INTEGER) * 100 AS perf_4, avg((h4 >= 2)::INTEGER) * 100 AS more_4_2, avg((o4 = truth)::INTEGER) * 100 AS vote_4, avg((o1 = truth)::INTEGER) * 100 AS vote_1 FROM e JOIN w USING (qid)),
    p AS (SELECT sum((prediction = 'B')::INTEGER) / count(*) * 100 AS "prior_B", sum((prediction IS NULL)::INTEGER) / count(*) * 100 AS "prior_-" FROM q)
    SELECT metric, round(value, 6) AS value FROM (SELECT * FROM m, p) UNPIVOT (value FOR metric IN (acc_1, acc_4, perf_1, perf_4, more_4_2, vote_4, vote_1, "prior_B", "prior_-"))""")
def circular_metrics(spark, d):
    rows = table(spark, d, "lineitem")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    rows = rows.select(F.col("l_orderkey").alias("qid"), pick(replicas.patterns(), F.col("l_linenumber") % 4).alias("pattern"), pick(["A", "B", "C", "D", None], F.col("l_partkey") % 5).alias("prediction"), F.lit("A").alias("answer"))
    out = replicas.circular_metrics(rows, "qid", "prediction", "answer", "pattern")
    return out.where(F.col("metric").isin("acc_1", "acc_4", "perf_1", "perf_4", "more_4_2", "vote_4", "vote_1", "prior_B", "prior_-")).withColumn("value", r6("value"))


@query("""
    WITH i AS (SELECT o_orderpriority AS subdivision, o_orderkey, avg(s) AS s FROM (SELECT o_orderpriority, o_orderkey, unnest([1.0, (o_orderkey % 2)::DOUBLE, (o_orderkey % 3 = 0)::INTEGER::DOUBLE]) AS s FROM orders) GROUP BY ALL)
    SELECT subdivision, round(100 * avg(s), 6) AS score, count(*)::BIGINT AS n_items FROM i GROUP BY 1 UNION ALL SELECT NULL, round(100 * avg(s), 6), count(*)::BIGINT FROM i""")
def replica_scores(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("subdivision"), "o_orderkey", F.explode(F.array(F.lit(1.0), (k % 2).cast("double"), (k % 3 == 0).cast("double"))).alias("s"))
    return replicas.replica_scores(rows, "subdivision", "o_orderkey", "s", 3).withColumn("score", r6("score"))


@query("""
    WITH u AS (SELECT user_id, count(*) AS n, sum((value >= 50)::INTEGER) AS c, max(value) AS w FROM events GROUP BY 1),
    p AS (SELECT *, CASE WHEN c = 0 THEN 0 WHEN n - c < 2 THEN 1 ELSE 1 - list_aggregate(list_transform(range((n - c + 1)::BIGINT, (n + 1)::BIGINT), lambda i: 1 - 2.0::DOUBLE / i), 'product') END AS p FROM u WHERE n >= 2)
    SELECT round(sum(p * w) / sum(w), 6) AS pass, count(*)::BIGINT AS n_items FROM p""")
def weighted_pass_at_k(spark, d):
    e = table(spark, d, "events")
    enough = e.groupBy("user_id").count().where("count >= 2").select("user_id")
    rows = e.join(enough, "user_id").withColumn("passed", (F.col("value") >= 50).cast("int"))
    return replicas.weighted_pass(rows, "user_id", "passed", "value", 2).withColumn("pass", r6("pass"))


@query("""
    WITH t AS (SELECT user_id, count(*)::DOUBLE AS n, sum((value >= 50)::INTEGER)::DOUBLE AS c FROM events GROUP BY 1 HAVING count(*) >= 3)
    SELECT user_id, round(2.0 / 3 * c * (c - 1) * (c - 2) / (n * (n - 1) * (n - 2)), 6) AS mg_pass FROM t""")
def mg_pass_at_k(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("value") >= 50).cast("long")).alias("c")).where("n >= 3")
    return u.select("user_id", r6(replicas.mean_g_pass(F.col("n"), F.col("c"), 3)).alias("mg_pass"))


@query(f"""
    SELECT n_nationkey, o AS swapped, CASE WHEN o THEN b ELSE a END AS shown_first, {_DRAW.format("'5:' || n_nationkey")} < 0.5 AS drawn FROM (SELECT n_nationkey, 'one ' || n_name AS a, 'two ' || n_name AS b FROM nation), (SELECT unnest([false, true]) AS o)""")
def judge_orders(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("one "), "n_name").alias("a"), F.concat(F.lit("two "), "n_name").alias("b"))
    drawn = replicas.random_order(n, "n_nationkey", "a", "b", 5).select("n_nationkey", F.col("swapped").alias("drawn"))
    return replicas.both_orders(n, "a", "b").select("n_nationkey", "swapped", "shown_first").join(drawn, "n_nationkey")


# --- estimates and ensembles --------------------------------------------------------------------------

_EVENTS = "(SELECT event_type AS model, user_id AS item, avg((value >= 50)::INTEGER) AS score FROM events GROUP BY ALL)"


def _by_user(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("item")).agg(F.avg((F.col("value") >= 50).cast("double")).alias("score"))


@query(f"""
    WITH s AS {_EVENTS}, b AS (SELECT model, item % 4 AS task, avg(score) AS f, sum(CASE WHEN item % 3 = 0 THEN score * (1 + item % 5) END) / sum(CASE WHEN item % 3 = 0 THEN 1 + item % 5 END) AS p FROM s GROUP BY ALL)
    SELECT model, round(sum(f * (task + 1)) / sum(task + 1), 6) AS full_score, round(sum(p * (task + 1)) / sum(task + 1), 6) AS part_score FROM b GROUP BY 1""")
def task_balanced_scores(spark, d):
    rows = _by_user(spark, d).withColumn("task", F.col("item") % 4)
    anchors = rows.where("item % 3 = 0").select("item", (1 + F.col("item") % 5).cast("double").alias("weight")).distinct()
    weights = rows.select("task").distinct().withColumn("task_weight", (F.col("task") + 1).cast("double"))
    return estimates.task_balanced(rows, anchors, "model", "task", "item", "score", weights).withColumns({c: r6(c) for c in ("full_score", "part_score")})


def _curves(rows):
    """Item parameters from the item's number."""
    k = F.col("item")
    return rows.select("item").distinct().select("item", F.array((k % 3 + 1) / 2.0, (k % 2) / 4.0).alias("slope"), ((k % 5) - 2).cast("double").alias("difficulty"))


@query(f"""
    WITH s AS {_EVENTS}, i AS (SELECT DISTINCT item, (item % 3 + 1) / 2.0 AS a1, (item % 2) / 4.0 AS a2, (item % 5) - 2.0 AS b, item % 4 = 0 AS seen FROM s),
    t AS (SELECT DISTINCT model, length(model) / 10.0 AS t1, 0.5 AS t2 FROM s), u AS (SELECT model, avg(1 / (1 + exp(-((a1 * t1 - b) + (a2 * t2 - b))))) AS predicted FROM t, i WHERE NOT seen GROUP BY 1),
    n AS (SELECT sum(seen::INTEGER) / count(*) AS share FROM i), f AS (SELECT model, avg(score) AS full_score, avg(CASE WHEN item % 4 = 0 THEN score END) AS data_part FROM s GROUP BY 1)
    SELECT model, round(full_score, 6) AS full_score, round(data_part, 6) AS data_part, round(predicted, 6) AS predicted, round(share * data_part + (1 - share) * predicted, 6) AS part_score FROM f JOIN u USING (model), n""")
def p_irt_scores(spark, d):
    rows = _by_user(spark, d)
    thetas = rows.select("model").distinct().select("model", F.array(F.length("model") / 10.0, F.lit(0.5)).alias("theta"))
    out = estimates.p_irt(rows, rows.where("item % 4 = 0").select("item"), _curves(rows), thetas)
    return out.withColumns({c: r6(c) for c in ("full_score", "data_part", "predicted", "part_score")})


@query()
def gp_irt_scores(spark, d):
    rows = _by_user(spark, d)
    anchors = rows.where("item % 4 = 0").select("item").distinct().withColumn("weight", F.lit(1.0))
    return estimates.gp_irt(rows, rows, anchors, _curves(rows)).withColumns({c: F.round(c, 4) for c in ("full_score", "part_score", "share")})


@query(f"""
    WITH s AS {_EVENTS}, m AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS place FROM (SELECT DISTINCT model FROM s)), z AS (SELECT count(*) AS n FROM m),
    c AS (SELECT combo, k, row_number() OVER (ORDER BY k, combo DESC) AS attempt FROM (SELECT range AS combo, bit_count(range)::INTEGER AS k FROM range(1, (1 << 5))) WHERE k >= 2),
    v AS (SELECT item, place, (score >= 0.5)::INTEGER AS vote FROM s JOIN m USING (model)),
    g AS (SELECT combo, k, attempt, item, count(*) AS h, sum(vote) AS y FROM v, c, z WHERE combo & (1 << (n - 1 - place)::INTEGER) <> 0 GROUP BY ALL),
    a AS (SELECT combo, k, attempt, round(avg(CASE WHEN 2 * y > h THEN 1 WHEN 2 * y < h THEN 0 ELSE ({_DRAW.format("'9:' || item || ':' || attempt")} < 0.5)::INTEGER END), 12) AS accuracy FROM g GROUP BY ALL),
    b AS (SELECT *, least(floor((accuracy - 0.2) / ((0.9 - 0.2) / 6)), 5)::BIGINT AS bin FROM a WHERE accuracy BETWEEN 0.2 AND 0.9)
    SELECT bin, combo::BIGINT AS combo, k, attempt::BIGINT AS attempt, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY attempt) AS r FROM b) WHERE r = 1""")
def ensemble_search(spark, d):
    from pyspark.sql import Window

    rows = _by_user(spark, d)
    models = rows.select("model").distinct().withColumn("place", (F.row_number().over(Window.orderBy("model")) - 1).cast("long"))  # five event types
    votes = rows.join(F.broadcast(models), "model").select("item", "place", (F.col("score") >= 0.5).cast("int").alias("vote"))
    tie = sampling.uniform(9, "item", "attempt") < 0.5
    return ensembles.fill_bins(votes, models.count(), 6, 0.2, 0.9, tie).withColumn("accuracy", r6("accuracy"))


@query(f"""
    WITH s AS {_EVENTS}, z AS (SELECT count(DISTINCT model) AS n FROM s), o AS (SELECT model, avg(score) AS own FROM s GROUP BY 1), w AS (SELECT min(own) AS low, max(own) AS high FROM o),
    i AS (SELECT item FROM s GROUP BY 1 HAVING count(DISTINCT model) = (SELECT n FROM z)), p AS (SELECT model, own, avg(score) AS mean, row_number() OVER (ORDER BY own, model) - 1 AS place FROM s JOIN i USING (item) JOIN o USING (model) GROUP BY model, own),
    c AS (SELECT range AS combo, bit_count(range)::INTEGER AS k FROM range(1, 1 << 5)), a AS (SELECT combo, k, round(avg(mean), 12) AS accuracy FROM c, p, z WHERE k >= 2 AND combo & (1 << (n - 1 - place)::INTEGER) <> 0 GROUP BY ALL),
    b AS (SELECT *, least(floor((accuracy - round(low, 12)) / ((high - low) / 4)), 3)::BIGINT AS bin FROM a, w WHERE accuracy BETWEEN round(low, 12) AND round(high, 12)),
    f AS (SELECT *, round(abs(accuracy - (low + (bin + 0.5) * ((high - low) / 4))), 12) AS dist FROM b), l AS (SELECT max(k0) AS last, count(*) AS bins FROM (SELECT bin, min(k) AS k0 FROM f GROUP BY 1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY dist, k, combo DESC) AS r FROM f, l WHERE bins < 4 OR k <= last)
    SELECT bin, combo::BIGINT AS combo, k, round(accuracy, 6) AS accuracy FROM r WHERE r = 1""")
def mean_ensemble_search(spark, d):
    return ensembles.mean_bins(_by_user(spark, d), 4).select("bin", "combo", "k", r6("accuracy").alias("accuracy"))


# --- reports ------------------------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'Attribute' WHEN 'view' THEN 'Attribute' ELSE event_type END AS category, 100 * avg((value >= 50)::INTEGER) AS a FROM events GROUP BY 1)
    SELECT category, round(a, 6) AS accuracy FROM c UNION ALL SELECT 'Avg ACC', round(avg(a), 6) FROM c""")
def category_averages(spark, d):
    rows = table(spark, d, "events").withColumn("hit", (F.col("value") >= 50).cast("int"))
    return breakdowns.category_average(rows, "event_type", "hit", {"click": "Attribute", "view": "Attribute"}).withColumn("accuracy", r6("accuracy"))


@query(f"""
    SELECT 'Overall' AS level, 'Overall' AS value, round(100 * avg(score), 6) AS accuracy FROM {_HITS} UNION ALL SELECT 'l_linestatus', l_linestatus, round(100 * avg(score), 6) FROM {_HITS} GROUP BY l_linestatus
    UNION ALL SELECT 'few', 'few', round(100 * avg(score), 6) FROM {_HITS} WHERE l_linenumber < 3""")
def default_report(spark, d):
    rows = _hits(spark, d).withColumn("few", F.when(F.col("l_linenumber") < 3, "few"))
    return breakdowns.overall_and_categories(rows, "score", "l_linestatus", "few").withColumn("accuracy", r6("accuracy"))


@query("""
    WITH r AS (SELECT (quality = 1) AS t, (n_chars >= 600) AS p, unnest(CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [lang] END) AS split FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT split, sum((t AND p)::INTEGER)::DOUBLE AS tp, sum((NOT t AND p)::INTEGER)::DOUBLE AS fp, sum((t AND NOT p)::INTEGER)::DOUBLE AS fn, avg((t = p)::INTEGER) AS accuracy FROM (SELECT * FROM r UNION ALL SELECT t, p, 'Overall' FROM r) GROUP BY 1),
    x AS (SELECT split, accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
    SELECT split, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x""")
def listed_category_f1(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    rows = rows.withColumn("categories", F.when(F.col("doc_id") % 2 == 0, F.concat_ws(",", "lang", "source")).otherwise(F.col("lang")))
    out = breakdowns.listed_category_f1(rows, "categories", F.col("quality"), (F.col("n_chars") >= 600).cast("int"))
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


@query("""
    WITH r AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'clean' WHEN o_custkey % 3 = 1 THEN 'input' ELSE 'input-and-label' END AS kind, (o_orderstatus = 'F')::INTEGER AS hit FROM orders)
    SELECT kind, round(100 * avg(hit), 6) AS accuracy, count(*)::BIGINT AS n FROM (SELECT * FROM r UNION ALL SELECT 'all', hit FROM r) GROUP BY 1""")
def contamination_classes(spark, d):
    m = F.col("o_custkey") % 3
    rows = table(spark, d, "orders").select(F.when(m == 0, "clean").when(m == 1, "input").otherwise("input-and-label").alias("kind"), (F.col("o_orderstatus") == "F").cast("int").alias("hit"))
    return breakdowns.contamination_classes(rows, "kind", "hit").withColumn("accuracy", r6("accuracy"))


@query("""
    WITH c AS (SELECT event_type, floor(value) AS value, sum((user_id % 2)::INTEGER) AS pos, count(*) AS n FROM events GROUP BY ALL),
    r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m, sum(pos) OVER (PARTITION BY event_type) AS total FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value DESC ROWS UNBOUNDED PRECEDING))
    SELECT event_type, value::DOUBLE AS value, round(tp / m, 6) AS precision, round(CASE WHEN total > 0 THEN tp / total ELSE 0 END, 6) AS recall FROM r""")
def precision_recall_curves(spark, d):
    rows = table(spark, d, "events").select("event_type", F.floor("value").cast("double").alias("value"), (F.col("user_id") % 2).cast("int").alias("truth"))
    return breakdowns.precision_recall_curve(rows, "truth", "value", "event_type").withColumns({c: r6(c) for c in ("precision", "recall")})


@query("""
    WITH s AS (SELECT user_id, event_id, value, (event_type = 'click')::INTEGER AS h FROM events), x AS (SELECT *, sum(h) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM s)
    SELECT user_id, section::BIGINT AS section, round(avg(value), 6) AS average, count(*)::BIGINT AS n FROM x WHERE h = 0 GROUP BY ALL""")
def section_averages(spark, d):
    out = breakdowns.section_averages(table(spark, d, "events"), "event_id", F.col("event_type") == "click", "value", "user_id")
    return out.withColumn("average", r6("average"))


@query("""
    WITH s AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL)
    SELECT user_id, event_type, v, max(v) OVER (PARTITION BY user_id) - v <= 1e-6 AS best FROM s""")
def highlighted_scores(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(r6(F.avg("value")).alias("v"))
    return breakdowns.highlighted(rows, "user_id", "v")


@query("""
    WITH l AS (SELECT l_orderkey, list_sort(list(-l_quantity)) AS x FROM lineitem GROUP BY 1), k AS (SELECT *, greatest(floor(len(x) * 0.4), 1)::BIGINT AS k FROM l)
    SELECT l_orderkey, round(-list_sum(x[1:k]) / k, 6) AS min_k FROM k""")
def weakest_token_means(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (-F.col("l_quantity")).alias("logprob"))
    return breakdowns.weakest_token_mean(rows, "l_orderkey", "logprob", 0.4).withColumn("min_k", r6("min_k"))


@query("""
    WITH m AS (SELECT l_orderkey, list(l_discount) AS x FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(list_avg(x), 6) AS vqa, round(CASE WHEN 1 - list_min(x) < 0.97 THEN 0 ELSE 1 - list_min(x) END, 6) AS doc, round(list_max(x), 6) AS chart FROM m""")
def reference_reductions(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("x"))
    return m.select("l_orderkey", r6(breakdowns.reference_scores(F.col("x"), "TextVQA_VAL")).alias("vqa"), r6(breakdowns.reference_scores(F.col("x"), "DocVQA_TEST", 0.97)).alias("doc"), r6(breakdowns.reference_scores(F.col("x"), "ChartQA_TEST")).alias("chart"))


@query("""
    WITH p AS (SELECT l_orderkey, sum(l_tax) AS total, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, o_custkey::DOUBLE AS weight, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE total / n END AS score FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
    SELECT round(sum(weight * coalesce(score, 1.0)) / sum(weight), 6) AS score, sum((score IS NULL)::INTEGER)::BIGINT AS n_missing FROM s""")
def missing_pages(spark, d):
    rows = table(spark, d, "lineitem").where("l_orderkey % 7 <> 0").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("_["), F.col("l_linenumber").cast("string"), F.lit("]")).alias("instance"), "l_tax")
    found = breakdowns.page_instances(rows, "instance", "l_tax").select("page", (F.col("total") / F.col("count")).alias("score"))
    weights = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("page"), F.col("o_custkey").cast("double").alias("weight"))
    return breakdowns.weighted_with_missing(weights, found, "page", "score", 1.0).withColumn("score", r6("score"))


@query("""
    WITH r AS (SELECT l_returnflag AS finish_reason, l_quantity AS t, -l_tax AS lp FROM lineitem)
    SELECT finish_reason, count(*)::BIGINT AS n, sum(t) AS tokens, round(-sum(lp), 4) AS neg_logprob FROM r GROUP BY 1 UNION ALL SELECT NULL, count(*)::BIGINT, sum(t), round(-sum(lp), 4) FROM r""")
def rollout_totals(spark, d):
    rows = table(spark, d, "lineitem").withColumn("lp", -F.col("l_tax"))
    return breakdowns.rollout_totals(rows, "lp", "l_quantity", "l_returnflag").withColumn("neg_logprob", F.round("neg_logprob", 4))


@query(f"""
    WITH w AS (SELECT l_partkey, coalesce(avg(score) FILTER (l_linestatus = 'F'), 0) AS f, coalesce(avg(score) FILTER (l_linestatus = 'O'), 0) AS o FROM {_HITS} GROUP BY 1)
    SELECT l_partkey, round(f, 6) AS "F", round(o, 6) AS "O", round((f + o) / 2, 6) AS row_mean FROM w""")
def filled_pivot(spark, d):
    return breakdowns.filled_pivot(_hits(spark, d), "l_partkey", "l_linestatus", ["F", "O"], "score").withColumns({c: r6(c) for c in ("F", "O", "row_mean")})


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - l_linenumber) / (l_quantity + l_linenumber + 1.0) AS x, (l_tax - l_discount) / (l_tax + l_discount + 1.0) AS y FROM lineitem), s AS (SELECT avg(x) AS mx, stddev_pop(x) AS dx, avg(y) AS my, stddev_pop(y) AS dy FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, round((x - mx) / dx, 5) AS length, round((y - my) / dy, 5) AS lists FROM p, s""")
def style_features(spark, d):
    out = breakdowns.style_features(table(spark, d, "lineitem"), {"length": ("l_quantity", "l_linenumber"), "lists": ("l_tax", "l_discount")})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("length", 5).alias("length"), F.round("lists", 5).alias("lists"))


# --- overlaps, prompts, growing results ---------------------------------------------------------------

_TURNS = "(SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_SPLIT = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\r]+'), lambda w: length(w) > 0)"


def _turns(spark, d):
    a = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    return a.join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])


@query(f"""
    WITH w AS (SELECT conv_id, turn, {_SPLIT.format('x')} AS xs, {_SPLIT.format('y')} AS ys FROM {_TURNS}),
    g AS (SELECT conv_id, turn, n, list_transform(range(1, greatest(len(xs) - n + 2, 1)::BIGINT), lambda i: array_to_string(xs[i:i + n - 1], ' ')) AS p, list_transform(range(1, greatest(len(ys) - n + 2, 1)::BIGINT), lambda i: array_to_string(ys[i:i + n - 1], ' ')) AS r FROM w, (SELECT unnest([1, 2, 3, 4]) AS n)),
    c AS (SELECT n, conv_id, turn, gram, sum(a) AS a, sum(b) AS b FROM (SELECT n, conv_id, turn, unnest(p) AS gram, 1 AS a, 0 AS b FROM g UNION ALL SELECT n, conv_id, turn, unnest(r), 0, 1 FROM g) GROUP BY ALL),
    t AS (SELECT n, sum(least(a, b)) / sum(a) AS p, sum(a) AS a, sum(b) AS b FROM c GROUP BY 1), u AS (SELECT list(p ORDER BY n) AS ps, max(CASE WHEN n = 1 THEN a END) AS a, max(CASE WHEN n = 1 THEN b END) AS b FROM t)
    SELECT round(brevity * CASE WHEN list_min(ps) > 0 THEN exp(list_sum(list_transform(ps, lambda v: ln(v))) / 4) ELSE 0 END, 6) AS bleu, round(brevity, 6) AS brevity FROM (SELECT *, CASE WHEN a > b THEN 1.0::DOUBLE ELSE exp(1 - b / a) END AS brevity FROM u)""")
def corpus_bleu(spark, d):
    out = overlap.corpus_bleu(_turns(spark, d), ["conv_id", "turn"], "x", "y")
    return out.select(r6("bleu").alias("bleu"), r6("brevity").alias("brevity"))


@query(f"""
    WITH t AS (SELECT p_partkey, {_NORMAL.format('p_name')} AS x, unnest([{_NORMAL.format('p_type')}, {_NORMAL.format("'The ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE ' x' END")}]) AS y FROM part),
    w AS (SELECT p_partkey, x, y, list_filter(string_split(x, ' '), lambda v: length(v) > 0) AS xs, list_filter(string_split(y, ' '), lambda v: length(v) > 0) AS ys FROM t),
    s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(xs), lambda v: least(len(list_filter(xs, lambda z: z = v)), len(list_filter(ys, lambda z: z = v))))), 0) AS same FROM w)
    SELECT p_partkey, max((x = y)::INTEGER) AS exact, round(max(CASE WHEN same > 0 THEN 2.0 * same / (len(xs) + len(ys)) ELSE 0 END), 6) AS f1 FROM s GROUP BY 1""")
def answer_scores(spark, d):
    more = F.concat(F.lit("The "), "p_name", F.when(F.col("p_partkey") % 2 == 0, "!").otherwise(" x"))
    rows = table(spark, d, "part").select("p_partkey", T.normal_answer(F.col("p_name")).alias("x"), F.array(T.normal_answer(F.col("p_type")), T.normal_answer(more)).alias("refs"))
    return overlap.answer_scores(rows, ["p_partkey"], "x", "refs").withColumn("f1", r6("f1"))


@query("""
    SELECT n_nationkey, label, coalesce((SELECT string_agg('Q: ' || r_name || ' {other}', chr(10) ORDER BY r_regionkey) || chr(10) FROM region WHERE r_regionkey < n_regionkey), '') || 'Name: ' || n_name || ' is ' || label || '?' AS prompt
    FROM nation, (SELECT unnest(['yes', 'no']) AS label)""")
def label_prompts(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    chosen = n.join(r, F.col("r_regionkey") < F.col("n_regionkey")).select("n_nationkey", F.col("r_regionkey").alias("rank"), "r_regionkey")
    context = prompts.in_context(n, chosen, r, "n_nationkey", "r_regionkey", "Q: {r_name} {other}", ["r_name"])
    rows = n.join(context, "n_nationkey")
    return prompts.label_prompts(rows, "context", "Name: {n_name} is {label}?", ["n_name"], {"yes": "yes", "no": "no"}).select("n_nationkey", "label", "prompt")


@query("""
    WITH n AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 2 = 0), o AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1)
    SELECT user_id, event_id FROM n WHERE r = 1 UNION ALL SELECT user_id, event_id FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def upserted_results(spark, d):
    e = table(spark, d, "events")
    old = e.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return upserts.upsert(old, e.where("event_id % 2 = 0").select("user_id", "event_id"), ["user_id"], "event_id")


@query(f"""
    WITH s AS {_EVENTS}, a AS (SELECT item, avg(score) AS accuracy, count(*)::BIGINT AS n FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY accuracy, item) AS lo, row_number() OVER (ORDER BY accuracy DESC, item DESC) AS hi FROM a)
    SELECT item, round(accuracy, 6) AS accuracy, n, CASE WHEN hi <= 4 THEN -3.0 WHEN lo <= 4 THEN 3.0 ELSE 0.0 END::DOUBLE AS difficulty FROM r""")
def starting_difficulties(spark, d):
    rows = _by_user(spark, d)
    return irt.item_accuracies(rows).join(irt.starting_difficulties(rows), "item").withColumn("accuracy", r6("accuracy"))


@query(f"""
    WITH s AS {_EVENTS}, c AS (SELECT model, (item % 5) - 2.0 AS b, sum(score) AS y, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT -4.0 + range * 0.01 AS theta FROM range(801)),
    l AS (SELECT model, theta, round(sum(n * ln(1 + exp(theta - b)) - y * (theta - b)), 9) AS loss FROM c, g GROUP BY ALL)
    SELECT model, round(first(theta ORDER BY loss, theta), 6)::DOUBLE AS theta FROM l GROUP BY 1""")
def abilities_1pl(spark, d):
    rows = _by_user(spark, d)
    return irt.ability_1pl(rows, rows.select("item").distinct().withColumn("difficulty", ((F.col("item") % 5) - 2).cast("double"))).withColumn("theta", r6("theta"))


@query("""
    WITH p AS (SELECT p_partkey, p_size / 10.0 - 2 AS t, (p_partkey % 7) / 2.0 - 1 AS b, 0.5 + (p_partkey % 3) AS a, 0.25 AS l FROM part)
    SELECT p_partkey, round(1 / (1 + exp(-(t - b))), 6) AS p1, round(1 / (1 + exp(-a * (t - b))), 6) AS p2, round(l + (1 - l / (1 + exp(-a * (t - b)))), 6) AS p3, round(l / (1 + exp(-a * (t - b))), 6) AS p4, round(ln(1 / 0.3 - 1) + t, 6) AS cut FROM p""")
def response_probabilities(spark, d):
    k = F.col("p_partkey")
    args = (F.col("p_size") / 10.0 - 2, (k % 7) / 2.0 - 1, 0.5 + (k % 3), F.lit(0.25))
    each = [r6(irt.response_probability(f"{n}pl", *args)).alias(f"p{n}") for n in (1, 2, 3, 4)]
    return table(spark, d, "part").select("p_partkey", *each, r6(irt.difficulty_threshold(F.lit(0.3), args[0])).alias("cut"))


@query("""
    SELECT c_custkey, o_orderkey AS subset, round(o_totalprice, 6) AS loss, x.i::BIGINT AS item, x.k::INTEGER AS rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders), (SELECT unnest([{'k': 1, 'i': 7}, {'k': 2, 'i': 3}]) AS x) WHERE r = 1""")
def chosen_examples(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("subset"), F.col("o_totalprice").alias("loss"))
    best = retrieval.least_description(o, "c_custkey", "subset", "loss").withColumn("loss", r6("loss"))
    return best.join(retrieval.fixed_k(best, "c_custkey", [7, 3]), "c_custkey")
