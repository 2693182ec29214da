import pytest
from pyspark.sql import functions as F
from rubrica.functions import dates, scoring, spans, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_markers_and_width_are_folded(spark):
    assert one(spark, "Ａ<$&0005&$><$&0006&$>  B ", text.clean_text("x")) == "A B"
    assert one(spark, "数据<$&0007&$>AI<$&0005&$>", text.clean_text("x", tag_field=True)) == "数据; AI"
    assert one(spark, "；Ａ ；； B", text.clean_text("x", tag_field=True)) == "A; B"
    assert one(spark, None, text.clean_text("x")) == ""
    assert one(spark, "é ß ﬁ", text.clean_text("x")) == "é ß fi"


def test_company_key_ignores_signs(spark):
    assert one(spark, "胜宏科技(惠州)股份有限公司", text.company_key("x")) == one(spark, "胜宏科技惠州股份有限公司", text.company_key("x"))


@pytest.mark.parametrize(("raw", "day"), [("2025-01-02 08:00:00", "2025-01-02"), ("2025/1/3", "2025-01-03"), ("2025-01-04", "2025-01-04"), ("2025/1/5 8:01", "2025-01-05"), ("soon", None)])
def test_dates(spark, raw, day):
    assert one(spark, raw, dates.iso_date(dates.parse_date("x"))) == day


def test_bad_dates_are_named(spark):
    df = spark.createDataFrame([("1", "2025-01-01"), ("2", "soon")], "id string, d string")
    with pytest.raises(ValueError, match="2='soon'"):
        dates.require_dates(df, "d", "id")


def test_tickers(spark):
    df = spark.createDataFrame([("000001.SZ",), ("000001.HK",), ("1.SZ",)], "x string")
    assert [r.x for r in df.where(text.is_ticker("x")).collect()] == ["000001.SZ"]


def test_dictionary_takes_the_highest_tier_with_a_hit(spark):
    hit = one(spark, "熟悉Python和SQL, 机器学习, 机器学习, NLP", scoring.dictionary_hits("x"))
    assert (hit.score, hit.hits) == (3, ["机器学习", "nlp"])
    assert one(spark, "ERP录入", scoring.dictionary_hits("x")).score == 1
    assert one(spark, "销售", scoring.dictionary_hits("x")).score == 0


@pytest.mark.parametrize(("role", "strict", "score"), [("none", False, 0), ("auxiliary", False, 1), ("core", False, 2), ("core", True, 3), ("none", True, None), ("auxiliary", True, None), ("other", False, None)])
def test_scores_follow_from_dimensions(spark, role, strict, score):
    assert one(spark, role, scoring.derive_score("x", F.lit(strict))) == score


def test_error_types_come_in_order(spark):
    want = {(1, 1): "match", (1, 2): "threshold_false_positive", (2, 1): "threshold_false_negative", (2, 3): "strict_ai_false_positive", (3, 2): "strict_ai_false_negative", (0, 1): "within_threshold_over", (1, 0): "within_threshold_under", (0, 3): "threshold_false_positive"}
    df = spark.createDataFrame(list(want), "r int, m int")
    assert {(x.r, x.m): x.e for x in df.select("r", "m", scoring.error_type("r", "m").alias("e")).collect()} == want


def test_wilson_stays_in_bounds(spark):
    low, high = scoring.wilson("k", "n")
    rows = spark.createDataFrame([(0, 10), (10, 10), (8, 32), (0, 0)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert rows[0].a == 0 and abs(rows[0].b - 0.2775401687666165) < 1e-12
    assert rows[1].b == 1
    assert abs(rows[2].a - 0.1325224398262155) < 1e-12 and abs(rows[2].b - 0.42106891770246624) < 1e-12
    assert rows[3].a != rows[3].a


def test_lists_and_versions(spark):
    assert one(spark, "a||b|", text.join_list(text.split_list("x"))) == "a|b"
    assert [text.version_label(v) for v in ("2.1.0", "2.0.0", "10.0", "1")] == ["v2_1", "v2", "v10", "v1"]
    assert one(spark, "岗位：工程师\nrest", text.title_line("x", "岗位：")) == "工程师"
    assert one(spark, "12x", text.to_long("x")) == 0


def test_spans_differ_in_width_case_and_signs_only():
    source = "负责ＰＬＣ编程，调试(现场)。"
    assert spans.find_span("编程", source) == "编程"
    assert spans.find_span("plc编程,调试", source) == "ＰＬＣ编程，调试"
    assert spans.find_span("PLC设计", source) is None
    assert spans.find_span("，。", "abc") is None and spans.find_span("", source) is None and spans.find_span(None, source) is None


def test_span_column_equals_the_function(spark):
    rows = [("编程", "负责编程"), ("ＡＢ", "ab c"), ("x", "abc"), (None, "abc"), ("x", None), ("", "a")]
    got = spark.createDataFrame(rows, "p string, s string").select(spans.source_span("p", "s").alias("y")).collect()
    assert [r.y for r in got] == [spans.find_span(p, s) for p, s in rows]


def test_search_form_keeps_the_way_back():
    assert spans.search_form("Ｓtraße, ﬁn!") == "strassefin"
    assert spans.find_span("STRASSE FIN", "die Ｓtraße, ﬁn!") == "Ｓtraße, ﬁ" + "n"
    for source in ("a-b.c  D", "（数据）分析、ＡＩ", "ßß x"):
        for i in range(len(source)):
            for j in range(i + 1, len(source) + 1):
                found = spans.find_span(source[i:j].upper(), source)
                assert (found is None) == (not spans.search_form(source[i:j])) or found in source
                assert found is None or spans.search_form(found).startswith(spans.search_form(source[i:j])) or found == source[i:j].upper()


FIELDS = ["软件工程师", "负责嵌入式软件开发，熟悉C语言。参与测试", "五险一金"]


def recover(spark, said, fields=FIELDS):
    df = spark.createDataFrame([(said, *fields)], "e string, a string, b string, c string")
    return spans.with_recovered(df, "y", "e", "a", "b", "c").first()["y"]


def test_evidence_is_recovered_from_prose(spark):
    assert recover(spark, "原文写明“负责嵌入式软件开发”，所以为核心") == "负责嵌入式软件开发"
    assert recover(spark, "原文写明“参与测试”和“负责嵌入式软件开发”") == "负责嵌入式软件开发"  # the longest
    # a quotation in doubt gives way to the chunk with the most terms
    assert recover(spark, "仅凭“软件工程师”还不够，嵌入式和软件开发是核心") == "负责嵌入式软件开发"
    assert recover(spark, "该岗位需要嵌入式软件能力") == "负责嵌入式软件开发"
    # chunks of the fields are too short: the longest common stretch
    assert recover(spark, "zz五险,一金x", ["abc", "", "五险,一金"]) == "五险,一金"
    assert recover(spark, "zzzz") is None and recover(spark, "") is None and recover(spark, None) is None
    assert recover(spark, "软件开发", [None, None, None]) is None
    long = "数据" * 200
    assert recover(spark, f"“{long}”", ["", long, ""]) == long[: spans.LONGEST]


def test_chunks_are_ranked_by_terms_pairs_field_and_length(spark):
    fields = ["数据分析员", "整理数据报表，使用系统软件处理数据。其他", "数据,软件"]
    # 20 a term: three terms in the second chunk of the description beat two and one
    assert recover(spark, "涉及数据、系统与软件的使用", fields) == "使用系统软件处理数据"
    # equal terms: the description is worth more than the title, tags least of all
    assert recover(spark, "都是模型xx", ["一二模型三四", "五六模型七八", "九十模型甲乙"]) == "五六模型七八"
    assert recover(spark, "ABCDEF ghijk", ["xabcdefx", "", ""]) == "xabcdefx"  # pairs alone, four or more
