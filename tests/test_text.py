"""Literal fixtures of recognised, edited, translated and exported text."""

from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.operators import diagnostics, editing, export, recognition, search, translation


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_language_aliases(spark):
    rows = spark.createDataFrame([("fre",), ("ger",), ("ko",), ("es",), (" Japanese ",), ("zho",), (None,)], "language string")
    found = recognition.resolve_language(rows).collect()
    assert [r.language_code for r in found] == ["fra", "deu", "kor", "spa", "jpn", None, None]
    assert [r.reading_order for r in found[:5]] == ["left_to_right"] * 4 + ["right_to_left"] and found[5].error.endswith("zho")


def test_normalisation(spark):
    rows = spark.createDataFrame([(1, "(テスト)...—!"), (2, "naïve cœur ¿Qué? Straße perché"), (3, None), (4, "é"), (5, "")], "id long, text string")
    japanese = {r.id: r.normalized for r in recognition.normalize_text(rows, japanese=F.lit(True)).collect()}
    assert japanese[1] == "（テスト）⋯ー！" and japanese[3] is None and japanese[5] == ""
    other = {r.id: r.normalized for r in recognition.normalize_text(rows).collect()}
    assert other[2] == "naïve cœur ¿Qué? Straße perché" and other[4] == "é"
    log = [(r.rule, r.after) for r in recognition.normalization_log(rows.where("id = 1"), ["id"]).collect()]
    assert [r for r, _ in log] == ["japanese-centered-ellipsis-v1", "japanese-prolonged-sound-mark-v1", "japanese-fullwidth-symbol-v1"] and log[-1][1] == "（テスト）⋯ー！"


def test_controls(spark):
    rows = spark.createDataFrame([("a\u0007",), ("b",), ("c\u0085",), (None,)], "text string")
    assert [r.codepoint for r in recognition.reject_controls(rows).collect()] == ["U+0007", "U+0085"]


def test_model_json(spark):
    rows = spark.createDataFrame([('```json\n{"a": 1}\n```\nbye',), (' {"a": 2} ',), ("{",), (None,)], "content string")
    found = recognition.parse_model_json(rows, "a bigint").collect()
    assert [r.parsed.a if r.parsed else None for r in found] == [1, 2, None, None] and [r.error is None for r in found] == [True, True, False, False]


def test_line_rules(spark):
    rows = spark.createDataFrame([(["a"], 2, "horizontal_tb"), ([], None, "vertical_rl"), (["a", ""], None, "vertical_rl"), (["a"], 1, "vertical_rl")], "lines array<string>, expected_units int, writing_mode string")
    found = [r.error for r in recognition.validate_lines(rows).collect()]
    assert "found 2 large main-text rows" in found[0] and found[1:] == ["main text has no lines", "main text line is empty", None]


def annotations(spark, line, notes, mode="horizontal_tb"):
    rows = spark.createDataFrame([(1, i, 1, base, n, "よみ", position) for i, (base, n, position) in enumerate(notes, 1)], "block_id long, annotation_index int, line_index int, base string, base_occurrence int, text string, position string")
    lines = spark.createDataFrame([(1, 1, line, mode)], "block_id long, line_index int, line string, writing_mode string")
    return recognition.place_annotations(rows, lines), lines


def test_annotations(spark):
    placed, lines = annotations(spark, "司る", [("司", 1, "over")])
    assert recognition.validate_annotations(placed).first().error is None
    spans = recognition.assemble_spans(lines.withColumn("line_id", F.lit(1)), placed.withColumnRenamed("block_id", "line_id").withColumn("position", F.col("ruby_position")), text="line").orderBy("ord").collect()
    assert [(s.type, s.base or s.text) for s in spans] == [("ruby", "司"), ("text", "る")] and spans[0].annotations[0].text == "よみ"
    for line, notes, mode, said in (("漢字字幕", [("漢字", 1, "over"), ("字字幕", 1, "over")], "horizontal_tb", "ruby ranges overlap"), ("漢字幕", [("漢字", 1, "over"), ("字幕", 1, "over")], "horizontal_tb", "ruby ranges overlap"), ("a", [("a", 1, "over")], "vertical_rl", "annotation placement is invalid"), ("a", [("b", 1, "over")], "horizontal_tb", "annotation base was not found: b"), ("漢字", [("漢", 1, "over"), ("漢", 1, "under")], "horizontal_tb", None)):
        assert recognition.validate_annotations(annotations(spark, line, notes, mode)[0]).first().error == said


def test_occurrences_do_not_overlap(spark):
    at = lambda t, n, k: value(spark, X.nth_occurrence(F.lit(t), F.lit(n), F.lit(k)))
    assert at("aaaa", "aa", 2) == 2 and at("aaaa", "aa", 3) is None and at("a\\Eb\\E", "\\E", 2) == 4 and at("𠮷x", "x", 1) == 1 and at("a", "", 1) is None


def test_completions_and_usage(spark):
    rows = spark.createDataFrame([('{"choices":[{"message":{"content":"x"}}],"usage":{"prompt_tokens":3,"prompt_tokens_details":{"cached_tokens":2}}}', 200), ('{"content":[{"type":"text","text":"y"}],"usage":{"input_tokens":4,"output_tokens":1}}', 200), ("no", 503), ("{}", 200)], "body string, http_status int")
    found = recognition.usage_summary(recognition.parse_completions(rows)).collect()
    assert [r.content for r in found] == ["x", "y", None, None] and found[2].error == "status 503: no" and found[3].error
    assert [r.input_tokens for r in found] == [3, 4, None, None] and found[0].cache_read_input_tokens == 2


def test_rounds_ask_only_failures_again(spark, tmp_path):
    requests = spark.createDataFrame([(i, "s", f"v{i}") for i in range(6)], "request_id long, stable string, variable string")

    def backend(batch):
        return ["ok" if i % 2 == 0 or "rejected" in v else "bad" for i, v in zip(batch.request_id, batch.variable, strict=True)]

    def save(df, n):
        df.write.parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    judge = lambda df: df.withColumn("error", F.when(F.col("response") != "ok", "wrong"))
    out = recognition.retry_rounds(requests, backend, judge, save)
    assert sorted((r.request_id, r.attempt, r.error) for r in out.collect()) == [(i, 1 if i % 2 == 0 else 2, None) for i in range(6)]


def test_three_phases(spark):
    blocks = spark.createDataFrame([(1, "eng", "horizontal_tb", 1, [3], None), (2, "eng", "vertical_rl", None, [], "again")], "request_id long, language_code string, writing_mode string, units int, expected_glyphs array<int>, correction string")
    presets = spark.createDataFrame([("eng", s, "read") for s in ("main_text", "ruby", "style")], "language string, stage string, instructions string")
    stage = lambda asked, name: asked.select("request_id", F.lit(name).alias("response"), F.when((F.col("request_id") == 2) & (F.lit(name) == "main_text"), "e").alias("error"))
    found = {r.request_id: r for r in recognition.recognise(blocks, presets, stage, ruby=True).collect()}
    assert (found[1].ruby, found[1].style, found[2].ruby) == ("ruby", "style", None)
    prefixes = recognition.build_requests(blocks, presets).groupBy("language_code", "writing_mode", "stage").agg(F.countDistinct("stable").alias("n"))
    assert {r.n for r in prefixes.collect()} == {1}


SPAN = dict(type="text", text="a", base=None, annotations=None, styles=["bold"], color=None)


def edit(spark, start=0, end=1, blocks=None, **span):
    if blocks is None:
        blocks = [{"lines": [{"text": "a", "spans": [{**SPAN, **span}]}]}]
    schema = f"start_ms long, end_ms long, blocks array<struct<lines:array<struct<text:string,spans:array<{editing.SPAN}>>>>>"
    return editing.validate_edit(spark.createDataFrame([(start, end, blocks)], schema)).first().error


def test_edit_rules(spark):
    assert edit(spark) is None
    assert edit(spark, start=1) == "the cue end time must be later than its start time"
    assert edit(spark, blocks=[]) == "the subtitle must contain at least one text block"
    assert edit(spark, blocks=[{"lines": []}]) == "the subtitle must contain at least one line"
    good = {"lines": [{"text": "a", "spans": [SPAN]}]}
    assert edit(spark, blocks=[good, {"lines": []}]) == "subtitle block 2 has no lines"
    assert edit(spark, blocks=[good, {"lines": [{"text": "", "spans": []}]}]) == "subtitle block 2 line 1 is empty or contains control characters"
    assert edit(spark, text="b") == "subtitle line 1 does not match its structured spans"
    assert edit(spark, styles=["bold", "bold"]) == "subtitle line 1 contains duplicate text styles"
    assert edit(spark, styles=["superscript", "subscript"]) == "subtitle line 1 contains conflicting baseline styles"
    assert edit(spark, color="#12345") == "subtitle line 1 contains an invalid text color"
    assert edit(spark, type="ruby", base="a", annotations=[]) == "subtitle line 1 contains an incomplete ruby span"
    assert edit(spark, type="ruby", base="a", annotations=[{"text": "b", "position": "over"}]) is None


def spans(spark, rows):
    return spark.createDataFrame([(1, i, t, x if t == "text" else None, x if t == "ruby" else None, [{"text": "n", "position": "over"}] if t == "ruby" else None, s, c) for i, (t, x, s, c) in enumerate(rows)], "line long, ord int, type string, text string, base string, annotations array<struct<text:string,position:string>>, styles array<string>, color string")


def shape(df):
    return [(r.type, r.text or r.base, r.styles, r.color) for r in df.orderBy("ord").collect()]


def test_spans_merge(spark):
    df = spans(spark, [("text", "a", ["italic", "bold"], "#ffffff"), ("text", "", [], None), ("text", "b", ["bold", "italic"], None), ("ruby", "c", [], None), ("ruby", "d", [], None)])
    assert shape(editing.coalesce_spans(df)) == [("text", "ab", ["bold", "italic"], None), ("ruby", "c", [], None), ("ruby", "d", [], None)]


def edits(spark, start, end, style="bold", set_color=False, color=None):
    return spark.createDataFrame([(1, start, end, style, set_color, color)], "line long, sel_start long, sel_end long, style string, set_color boolean, color_value string")


def test_range_edits(spark):
    df = spans(spark, [("text", "abcd", [], None), ("ruby", "e", [], None)])
    assert shape(editing.restyle_ranges(df, edits(spark, 1, 3))) == [("text", "a", [], None), ("text", "bc", ["bold"], None), ("text", "d", [], None), ("ruby", "e", [], None)]
    assert shape(editing.restyle_ranges(df, edits(spark, 2, 2))) == [("text", "abcd", [], None), ("ruby", "e", [], None)]
    assert shape(editing.restyle_ranges(df, edits(spark, 3, 5, None, True, "#00ff00"))) == [("text", "abc", [], None), ("text", "d", [], "#00FF00"), ("ruby", "e", [], "#00FF00")]
    sup = spans(spark, [("text", "ab", ["superscript"], None)])
    assert shape(editing.restyle_ranges(sup, edits(spark, 0, 2, "subscript"))) == [("text", "ab", ["subscript"], None)]
    assert shape(editing.restyle_ranges(sup, edits(spark, 0, 2, "superscript"))) == [("text", "ab", [], None)]


def test_ruby_edits(spark):
    df = spans(spark, [("text", "abcd", ["bold"], None), ("ruby", "ef", [], None)])
    one = lambda a, b, end=1, line=1: spark.createDataFrame([(line, end, a, b, "x", "over")], "line long, end_line long, sel_start long, sel_end long, annotation string, position string")
    done, refused = editing.annotate_ranges(df, one(1, 3))
    assert refused.count() == 0 and shape(done) == [("text", "a", ["bold"], None), ("ruby", "bc", ["bold"], None), ("text", "d", ["bold"], None), ("ruby", "ef", [], None)]
    assert [editing.annotate_ranges(df, e)[1].first().reason for e in (one(1, 3, end=2), one(2, 2), one(0, 1, 9, 9), one(3, 5))] == ["several lines", "empty", "no such line", "cuts a ruby span"]
    gone = editing.remove_annotations(df, spark.createDataFrame([(1, 4, 6)], "line long, start long, end long"))
    assert shape(gone) == [("text", "abcd", ["bold"], None), ("text", "ef", [], None)]


def test_srt(spark):
    line = F.struct(F.lit("x").alias("text"), F.array(*[F.struct(F.lit("text").alias("type"), F.lit(t).alias("text"), F.lit("").alias("base"), F.array(*[F.lit(s) for s in st]).cast("array<string>").alias("styles")) for t, st in (("通常", []), ("強調", ["bold", "italic"]), ("<&", []))]).alias("spans"))
    assert value(spark, X.srt_line(line)) == "通常<b><i>強調</i></b>&lt;&amp;"
    assert value(spark, X.srt_timestamp(F.lit(3723004))) == "01:02:03,004" and value(spark, X.srt_timestamp(F.lit(360000000))) == "100:00:00,000"
    assert value(spark, X.base_name(F.lit(None).cast("string"), F.lit("Test / Movie"), F.lit("jpn"))) == "Test _ Movie.jpn"
    assert value(spark, X.timestamp_ms(F.lit(" 1:02:03.004 "))) == 3723004 and value(spark, X.timestamp_ms(F.lit("1:72:03.004"))) is None


def test_losses(spark):
    span = dict(type="ruby", text=None, base="a", annotations=[], styles=["superscript"], color="#FF0000")
    block = lambda mode, p: {"writing_mode": mode, "position": p, "lines": [{"text": "a", "spans": [span]}, {"text": "a", "spans": [span]}]}
    schema = f"cue_id long, cue_index int, blocks array<struct<writing_mode:string,position:string,lines:array<struct<text:string,spans:array<{editing.SPAN}>>>>>"
    rows = spark.createDataFrame([(1, 3, [block("horizontal_tb", "top-left")]), (2, 4, [block("horizontal_tb", "top-left"), block("vertical_rl", "top-right")])], schema)
    found = export.export_warnings(rows).orderBy("cue_id", "place").collect()
    assert [r.code for r in found if r.cue_id == 1] == ["ruby_flattened", "text_color_omitted", "baseline_styles_omitted"]
    assert [r.code for r in found if r.cue_id == 2] == [c for c, _ in export.LOSSES] and found[0].message == "Cue 3 contains ruby annotations; SRT keeps only the base text"


def test_translation_shapes(spark):
    expected = spark.createDataFrame([(c, 1, i) for c in range(1, 7) for i in (1, 2)], "cue_id long, block_index int, line_index int")
    got = [(1, 1, 1, "a"), (1, 1, 2, "b"), (2, 1, 1, "a"), (3, 1, 1, "a"), (3, 1, 1, "b"), (4, 1, 1, "a"), (4, 1, 3, "b"), (5, 1, 1, " "), (5, 1, 2, "b")]
    found = translation.validate_translation(expected, spark.createDataFrame(got, "cue_id long, block_index int, line_index int, text string"))
    assert {r.cue_id: r.error for r in found.collect()} == {1: None, 2: "expected 2 lines, received 1", 3: "line mapping is empty or duplicated", 4: "line index is out of range", 5: "line mapping is empty or duplicated", 6: "expected 1 blocks, received 0"}


def test_redaction(spark):
    deep = "1"
    for _ in range(14):
        deep = '{"a":' + deep + "}"
    rows = [('{"api_key":"x","headers":{"Authorization":["y"]},"image":"data:image/png;base64,QUJD","note":"my s3cret"}',), ('{"n":[' + ",".join("1" * 300) + "]}",), (deep,), ("{half",), (None,)]
    found = [r.details for r in diagnostics.redact_details(spark.createDataFrame(rows, "details string"), secrets=("s3cret",)).collect()]
    assert found[0] == '{"api_key":"[REDACTED]","headers":{"Authorization":"[REDACTED]"},"image":{"redacted":"base64_data","estimated_byte_length":3},"note":"my [REDACTED]"}'
    assert '"byte_length":300' in found[1] and "[TOO DEEP]" in found[2] and found[3] == '"[NOT JSON]"' and found[4] is None


def test_search(spark):
    rows = spark.createDataFrame([(1, "Hello"), (12, None)], "cue_index long, text string")
    assert [search.search_cues(rows, q).count() for q in ("", " hELLO ", "00012", "zz")] == [2, 1, 1, 0]


def test_glossary_of_any_size(spark, monkeypatch):
    """Both ways of a glossary without a project, and that by project, find the same terms: short, empty, repeated and null ones too."""
    from cuelake.operators import translation

    texts = spark.createDataFrame([(1, "p", "the red fox", "le renard"), (2, "p", "", "x"), (3, "q", None, None), (4, "q", "漢字 fox", "renard"), (4, "q", "漢字 fox", "renard")], "k int, project string, text string, said string")
    terms = [("p", "fox", "renard"), ("p", "red fox", "roux"), ("p", "漢", "k"), ("p", "", ""), ("p", "fox", "renard"), ("p", None, "n"), ("p", "no such", "x"), ("p", "e ", "z")]
    glossary = spark.createDataFrame(terms, "project string, source string, mapped string")
    want = sorted((k, t, m in (s or "")) for k, _, x, s in (tuple(r) for r in texts.collect()) for _, t, m in terms if x is not None and t is not None and t in x)
    for small in (True, False):
        monkeypatch.setattr(translation, "_is_small", lambda df, small=small: small)
        out = translation.glossary_hits(texts, glossary, keys=("k",), translation="said", mapped="mapped")
        assert sorted((r.k, r.term, r.translated) for r in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    own = translation.glossary_hits(texts, glossary, keys=("k",), translation="said", mapped="mapped", project="project")
    assert sorted((r.k, r.term, r.translated) for r in own.collect()) == [w for w in want if w[0] < 3]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_dealt_by_number_of_rows(spark, small, monkeypatch):
    """However large the table, a task gets so many rows; and all that goes by line follows that one exchange."""
    from cuelake.plans import adapters

    monkeypatch.setattr(adapters, "ROWS_A_TASK", 500)
    spans = adapters.Tables(spark, small).spans()
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert spans.rdd.getNumPartitions() == -(-rows // 500) > 4
    plan = editing.with_offsets(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_lines_are_folded_once(spark, small):
    from cuelake.plans import queries

    assert plan_of(queries.QUERIES["restyle_ranges"](spark, small)).count("aggregate(coalesce(edits") == 1


def test_refusals_are_folded_once_from_places(spark, small):
    from cuelake.plans import queries

    plan = plan_of(queries.QUERIES["annotate_refused"](spark, small))
    assert plan.count("aggregate(edits") == 1 and not any(unneeded in plan for unneeded in ("substring(", "styles", "annotation#"))


def test_refusals_follow_earlier_edits(spark):
    """An annotation past the end of a line ends there, so the same range again cuts it; a removed one cuts nothing; an empty ruby span is cut from both sides only."""
    spans = spark.createDataFrame([(1, 1, "text", "abcd", None), (2, 1, "ruby", None, ""), (2, 2, "text", "ab", None), (3, 1, "text", "", None)], "line long, ord int, type string, text string, base string")
    told = [(1, 0, 2, 9, "annotate"), (1, 1, 2, 9, "annotate"), (1, 2, 2, 4, "annotate"), (1, 3, 1, 3, "annotate"), (1, 4, 2, 4, "remove"), (1, 5, 1, 3, "annotate"), (2, 0, 0, 1, "annotate"), (2, 1, -1, 1, "annotate"), (3, 0, 0, 1, "annotate"), (3, 1, 0, 1, "style")]
    edits = spark.createDataFrame(told, "line long, nth long, sel_start long, sel_end long, kind string").withColumns({"style": F.lit("bold"), "annotation": F.lit("n"), "position": F.lit("over")})
    refused = editing.edit_lines(spans, edits)[1]
    assert sorted(tuple(r) for r in refused.collect()) == [(1, 1, "cuts a ruby span"), (1, 3, "cuts a ruby span"), (2, 1, "cuts a ruby span"), (3, 0, "no such line")]
