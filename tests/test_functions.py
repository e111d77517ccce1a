import json

import pytest
from pyspark.sql import functions as F

from chronofold.functions import documents, embedding, speech, text, times

TZ = "Asia/Shanghai"


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*columns).first()


def test_tokens(spark):
    rows = {"Hello, World 2x": ["hello", "world", "2x"], "ＡＢ１ ok": ["ab1", "ok"], "好 天气x": ["x", "好", "天", "气", "天气"], "": [], None: []}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.w for r in df.select("t", text.tokens(F.col("t")).alias("w")).collect()} == rows


def test_estimates_and_compaction(spark):
    r = one(spark, text.token_estimate(F.lit("abcde")), text.token_estimate(F.lit("")), text.token_estimate(F.lit("é" * 4)), text.compact(F.lit("a  b\n c"), 10), text.compact(F.lit("abcdefghij"), 5), text.join_tags(F.array(F.lit(" a "), F.lit(""), F.lit("b"))))
    assert tuple(r) == (2, 1, 2, "a b c", "abcd…", "a b")


def test_redaction(spark):
    cases = {
        "Authorization: Bearer abcdefghijklmnop": "Authorization: Bearer [secret value omitted]",
        "key sk-abcdefghijklmnop done": "key [secret value omitted] done",
        'token = "0123456789abcdef"': 'token = "[secret value omitted]"',
        "password: 0123456789abcdef0": "password: [secret value omitted]",
        "the token variable is fine": "the token variable is fine",
        "tokens = 5": "tokens = 5",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", text.redact(F.col("t")).alias("o")).collect()} == cases


def test_terms_and_kinds(spark):
    pool = F.array(*map(F.lit, ["Alpha Beta", "alpha", "Gamma"]))
    r = one(spark, text.distinct_terms(F.array(*map(F.lit, [" A  b", "a B", "", "c"]))), text.keyword_witness(pool, F.lit("ALPHA")), text.keyword_witness(pool, F.lit("amm")), text.keyword_witness(pool, F.lit("gamma ray")), text.topics_without_entities(F.array(F.lit("X"), F.lit("y")), F.array(F.lit("x"))), text.kind_prefixes(F.lit("a.b.c")))
    assert tuple(r) == (["A b", "c"], "alpha", "Gamma", None, ["y"], ["a", "a.b", "a.b.c"])
    kinds = {"event.click": True, "event": False, "Event.x": False, "a..b": False, None: False}
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert {r.k: r.v for r in df.select("k", text.valid_kind(F.col("k")).alias("v")).collect()} == kinds
    assert one(spark, text.folded(F.lit("  Ｆｏｏ  BAR "))).asDict().popitem()[1] == "foo bar"
    assert tuple(one(spark, text.speaker_label(F.lit("[Bob]\n{x}: y")), text.valid_channel(F.lit("a-1")), text.valid_channel(F.lit("A")), text.clamp01(F.lit(7)), text.has_relative_time(F.lit("我昨天去了")))) == ("Bob x y", True, False, 1.0, True)


def test_local_time(spark):
    ts = 1_712_000_000  # 2024-04-02 03:33:20 in Shanghai
    c = F.lit(ts)
    r = one(spark, times.time_of_day(c, TZ), times.date_weekday_label(c, TZ), times.iso_label(c, TZ), times.range_label(c, c + 3600, TZ), times.range_label(c, c + 90000, TZ), times.iso_label(F.lit(0), TZ), times.iso_label(c, "America/New_York"))
    assert tuple(r) == ("midnight", "2024-04-02 周二", "2024-04-02T03:33:20+08:00", "2024-04-02 周二 03:33 ~ 04:33", "2024-04-02 周二 03:33 ~ 2024-04-03 周三 04:33", "", "2024-04-01T15:33:20-04:00")


def test_time_selectors():
    assert times.normal_periods(["晚上", "morning", "nonsense"]) == ["morning", "night"]
    day = times.time_range({"start_date": "2024-04-02", "end_date": "2024-04-02", "time_periods": ["早上"]}, TZ)
    assert day.end - day.start == 86400 and day.periods == ("morning",)
    assert times.time_range({"start_at": "2024-04-02T00:00:00", "end_at": "2024-04-02T01:00:00+08:00"}, TZ).start == day.start
    with pytest.raises(ValueError, match="nonexistent"):
        times.time_range({"start_at": "2024-03-10T02:30:00", "end_at": "2024-03-11T00:00:00"}, "America/New_York")
    with pytest.raises(ValueError, match="ambiguous"):
        times.time_range({"start_at": "2024-11-03T01:30:00", "end_at": "2024-11-04T00:00:00"}, "America/New_York")
    for bad in ({}, {"start_at": "2024-01-01", "start_date": "2024-01-01"}, {"start_at": "2024-01-02", "end_at": "2024-01-01"}):
        with pytest.raises(ValueError):
            times.time_range(bad, TZ)


def test_time_hints():
    assert times.time_hint(None, TZ) == times.time_hint({"date_label": " "}, TZ) == {} and times.time_hint({"time_of_day": "晚上"}, TZ) == {"time_periods": ["night"]}
    day = times.time_hint({"date_label": "2024-04-02", "time_of_day": "morning"}, TZ)
    assert day.end - day.start == 86400 and day.periods == ("morning",) and times.time_hint({"start_ts": "5"}, TZ) == {"start_ts": 5} and times.time_hint({"start_ts": 1, "end_ts": 9}, TZ) == times.TimeRange(1, 9)
    for bad, error in (({"start_ts": 1, "date_label": "2024-01-01"}, "exclusive"), ({"x": 1}, "unknown_time_hint"), ([], "object"), ({"time_of_day": "teatime"}, "periods"), ({"start_ts": True}, "integer"), ({"start_ts": 5, "end_ts": 5}, "before")):
        with pytest.raises(ValueError, match=error):
            times.time_hint(bad, TZ)


def test_documents(spark):
    value = {"b": 1, "a": [float("nan"), b"x"], "é": None}
    assert documents.canonical(value).startswith('{"a":["nan",{"binary_sha256":')
    dirty = {"api_key": "k", "file": {"type": "image", "data": "x"}, "note": "Bearer abcdefghijklmnop", "cache_path": "/tmp/x", "arguments": json.dumps({"password": "p", "n": 1}), "url": "data:image/png;base64,AAAA"}
    clean = documents.sanitised(dirty)
    assert clean["api_key"] == "[secret value omitted]" and clean["file"]["text"] == documents.MEDIA_MARK and "[secret value omitted]" in clean["note"] and clean["cache_path"] == documents.PATH_MARK
    assert json.loads(clean["arguments"]) == {"n": 1, "password": "[secret value omitted]"} and clean["url"] == documents.MEDIA_MARK
    for name in ("database_path", "db_path", "log_path", "run_log_path", "storage_relpath", "backing-path"):
        assert documents.sanitised({name: "/x"}) == {name: documents.PATH_MARK}
    assert documents.sanitised({"temp_path": "/x", "path": "/y", "list": [[{"a": []}], 1]}) == {"list": [[{"a": []}], 1], "path": "/y", "temp_path": "/x"}
    call = {"content": [{"type": "tool_use", "input": {"local_path": "C:", "api_key": "s"}}, {"type": "text", "local_path": "C:"}]}
    assert documents.sanitised_with_outcome(call) == ({"content": [{"input": {"api_key": documents.SECRET_MARK, "local_path": "C:"}, "type": "tool_use"}, {"local_path": documents.PATH_MARK, "type": "text"}]}, "skipped_unsafe")
    assert documents.sanitised_with_outcome({"a": "x\x00y", "arguments": '{"local_path": "q"}'}) == ({"a": "x y", "arguments": '{"local_path": "q"}'}, "complete")
    assert documents.sanitised_with_outcome([{"type": "image"}]) == ([{"type": "text", "text": documents.MEDIA_MARK}], "media_omitted")
    assert documents.sanitised('{"status":"ok","pt_key":"abcdefghijklmnopqrstuvwxyz123456","count":2}') == '{"status":"ok","pt_key":"[secret value omitted]","count":2}'
    long = json.dumps({"q": "x" * 2000, "l": ["y" * 2000], "s": "short"})
    r = one(spark, documents.shortened_arguments(F.col("j"), F.lit("s1")), documents.canonical_json(F.lit('{"b": 1, "a": 2}')), documents.canonical_json(F.lit("{")), documents.opaque_signature(F.lit('{"x": {"signature": "z"}}')), documents.opaque_signature(F.lit('{"input": {"signature": "z"}}')), j=long)
    cut = json.loads(r[0])
    assert len(cut["q"]) < 200 and cut["l"] == ["y" * 2000] and tuple(r)[1:] == ('{"a":2,"b":1}', None, True, False)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Hello there. How are you? Fine!", ["Hello there.", "How are you?", "Fine!"]),
        ("Dr. Smith paid 3.50 to e.g. Bob. Ok then.", ["Dr. Smith paid 3.50 to e.g. Bob.", "Ok then."]),
        ('He said "stop. now!" and left. Bye.', ['He said "stop. now!" and left.', "Bye."]),
        ("看《孤独摇滚！》吗？好。", ["看《孤独摇滚！》吗？", "好。"]),
        ("1. first item\n2. second item", ["1. first item", "2. second item"]),
        ("Use `a.b. c!` here. It's ok.", ["Use `a.b. c!` here.", "It's ok."]),
        ("Wait... what?!", ["Wait...", "what?!"]),
        ("Done! 2. next one. A; b.", ["Done!", "2. next one.", "A; b."]),
        ("A corp. is here.\n\n好……吧", ["A corp. is here.", "好……吧"]),
        ("", []),
    ],
)
def test_sentences(raw, want):
    assert speech.sentences(raw) == want


def test_long_sentences_cut_at_soft_marks():
    parts = speech.sentences("word, " * 80, most=60)
    assert all(len(p) <= 61 for p in parts) and "".join(parts).replace(" ", "") == "word," * 80
    assert speech.sentences("x" * 300, most=60) == ["x" * 300]


def streamed(text, size, **options):
    stream, events = speech.SpeechStream(**options), []
    for i in range(0, len(text), size):
        events += stream.feed(text[i : i + size])
    return events + stream.finish()


def test_replies(spark):
    assert speech.parse_reply("plain words")["status"] == "plain_text" and speech.parse_reply("{oops")["reason"] == "invalid_json"
    assert speech.parse_reply('{"x": 1}', "json")["status"] == "invalid_contract" and speech.parse_reply('{"x": 1}')["status"] == "output_unparsed" and speech.parse_reply("[1]")["reason"] == "json_not_object"
    reply = speech.parse_reply('{"speech": "Hi. You?", "memory_metadata": {"a": 1}, "emotion": "glad", "other": 2}')
    assert (reply["status"], reply["segments"], reply["metadata"], reply["presentation"], reply["extra"]) == ("parsed", ["Hi.", "You?"], {"a": 1}, {"emotion": "glad"}, {"other": 2})
    assert speech.parse_reply('{"speech": "a", "memory_metadata": 3}')["metadata_status"] == "invalid"
    assert one(spark, speech.sentence_array(F.lit("A b. C d.")))[0] == ["A b.", "C d."]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_streams(size):
    whole = 'Hello there. Hello there. He said "Hi." Dr. No left… … Done! 2. item three. Bye'
    events = streamed(whole, size)
    assert [e["text"] for e in events if e["type"] == "speech_segment"] == speech.sentences(whole) and events[-1]["payload"]["speech"] == whole
    raw = '{"a": {"speech": "no"}, "n": 1.5, "speech": "Hi \\u4f60\\ud83d\\ude00 you.\\nOk \\"q\\"!", "memory_metadata": {"x": [1]}}'
    events = streamed(raw, size)
    assert "".join(e["text"] for e in events if e["type"] == "speech_chunk") == 'Hi 你😀 you.\nOk "q"!' == events[-1]["payload"]["speech"]
    assert [e["text"] for e in events if e["type"] == "speech_segment"] == ["Hi 你😀 you.", 'Ok "q"!'] and [e["type"] for e in events[-2:]] == ["metadata_ready", "final"]
    with pytest.raises(ValueError):
        stream = speech.SpeechStream()
        stream.finish()
        stream.feed("x")


def test_hashed_embedding(spark):
    v = embedding.hashed("hello world 好天气")
    assert len(v) == 128 and abs(sum(x * x for x in v) - 1) < 1e-9 and embedding.hashed("") == [0.0] * 128
    assert embedding.self_check(lambda ts: [embedding.hashed(t) for t in ts], ("red apple pie", "apple pie red"), ("red apple", "slow train"))
    row = embedding.embed(spark.createDataFrame([("hello world 好天气",)], "t string"), "t").first()
    assert row.embedding == pytest.approx(v)
