import pytest
from pyspark.sql import functions as F

from chatterloom.functions import fixed_values as V
from chatterloom.functions import text as X
from chatterloom.operators import cleaning as C
from chatterloom.operators import sentiment as S


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t"))).first()[0]


SPELLING = [("ko", "không"), ("đc", "được"), ("chàj", "chài"), ("chài", "trời"), ("nhìu lém", "rất nhiều"), ("nhìu", "nhiều"), ("a.b", "ab")]


@pytest.mark.parametrize("inline", [1000, 0])
@pytest.mark.parametrize(
    "given, wanted",
    [
        ("ko biết KO", "không biết không"),
        ("Đc rồi, đc!", "được rồi, được!"),
        ("chàj chài", "chài trời"),
        ("koko ko_ xko", "koko ko_ xko"),
        ("nhìu lém nhìu lémx", "rất nhiều nhiều lémx"),
        ("axb a.b (ko)", "axb ab (không)"),
        ("", ""),
    ],
)
def test_spelling(spark, pairs_df, given, wanted, inline):
    df = spark.createDataFrame([(1, given)], "id bigint, t string")
    out = C.correct_spelling(df, "id", "t", pairs_df(SPELLING), inline)
    assert [r["t"] for r in out.collect()] == [wanted]


EMOTICONS = [(":)", " vui "), (":))", " cười "), ("<3", " yêu "), (":d", " hớn ")]


@pytest.mark.parametrize("inline", [1000, 0])
@pytest.mark.parametrize(
    "given, wanted",
    [
        (":) chào :)", " vui  chào  vui "),
        ("chào :))", "chào  cười "),
        ("chào:)", "chào:)"),
        ("x :dx :d", "x :dx  hớn "),
        ("<3<3", " yêu <3"),
    ],
)
def test_emoticons(spark, pairs_df, given, wanted, inline):
    df = spark.createDataFrame([(1, given)], "id bigint, t string")
    out = C.correct_emoticons(df, "id", "t", pairs_df(EMOTICONS), inline)
    # "<3<3": the first is followed by "<", the second preceded by "3", a word character.
    assert [r["t"] for r in out.collect()] == [wanted]


@pytest.mark.parametrize("inline", [1000, 0])
def test_emoji(spark, pairs_df, inline):
    df = spark.createDataFrame([(1, "a\U0001f603b :smiley: :smile")], "id bigint, t string")
    lookup = pairs_df([("\U0001f603", " vui vẻ"), (":smiley:", " vui vẻ")])
    out = C.correct_emoji(df, "id", "t", lookup, inline)
    assert out.first()["t"] == "a vui vẻ b  vui vẻ  :smile"


def test_composition(spark):
    assert len(V.COMPOSED_LETTERS) == 60
    assert one(spark, "Tiếng Á", X.compose_letters) == "Tiếng Á"
    assert one(spark, "ế Ồ ự", X.compose_letters) == "ế Ồ ự"


def test_url_and_symbols(spark):
    assert one(spark, "xem http://a.b/c?d=1&e=%20 nhé 12", X.drop_digits_and_urls) == "xem   nhé "
    assert one(spark, r"a\b!c?d`e^f&g$h*i(j)k+l=m#n<o>p~q", X.urls_and_symbols_to_blank) == "a b c d e f g h i j k l m n o p q"
    assert one(spark, "<b>x</b>", X.angle_brackets_to_blank) == " b x /b "


@pytest.mark.parametrize("inline", [1000, 0])
def test_stop_words(spark, words_df, inline):
    df = spark.createDataFrame([(1, "Anh và em VÀ x xin xin"), (2, "và")], "id bigint, t string")
    rows = C.remove_stop_words(df, "id", "t", words_df(["và", "anh"]), inline).orderBy("id").collect()
    assert [r["t"] for r in rows] == ["em xin xin ", ""]


def test_case_and_tones(spark):
    assert one(spark, "VN", X.lower_unless_caps) == "VN"
    assert one(spark, "Vn", X.lower_unless_caps) == "vn"
    assert one(spark, "hòa bình khóe thúy", X.move_tone_marks) == "hoà bình khoé thuý"
    assert one(spark, "Đòa Nội", X.phrase_key) == "đoà Nội"


def test_treebank_and_punctuation(spark):
    assert one(spark, "*E* a *T*-1 b E* c", X.drop_treebank_marks) == " a -1 b  c"
    assert one(spark, "a ,  b ( c ) “ d ” !", X.tighten_punctuation) == "a, b (c) “d”!"
    assert one(spark, 'x " a b c " mn " x y', X.trim_quotations) == 'x "a b c" mn "x y'


def test_names(spark):
    for word, wanted in [("Nam", True), ("Hà Nội", True), ("Hà nội", False), ("nam", False), ("12", True)]:
        assert one(spark, word, X.is_name) is wanted


@pytest.mark.parametrize("inline", [1000, 0])
def test_lookup_size_changes_no_result(spark, inline):
    """Repeated keys, case variants, null and empty keys, null texts and repeated row ids, whichever way is taken."""
    rows = [(1, "Ko đi :) x"), (1, "Ko đi :) x"), (2, None), (3, ""), (4, "ko KO akok")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    lookup = spark.createDataFrame([("ko", "aaa"), ("Ko", "không"), (None, "n"), ("", "e"), ("x", None), (":)", "a"), (":)", "vui")], "key string, value string")
    spelled = sorted(str(r["t"]) for r in C.correct_spelling(df, "id", "t", lookup, inline).collect())
    assert spelled == sorted(["không đi vui ", "không đi vui ", "None", "", "không không akok"])
    smiled = sorted(str(r["t"]) for r in C.correct_emoticons(df, "id", "t", lookup.where("key = ':)' OR key IS NULL"), inline).collect())
    assert smiled == sorted(["Ko đi vui x", "Ko đi vui x", "None", "", "ko KO akok"])
    shown = sorted(str(r["t"]) for r in C.correct_emoji(df, "id", "t", lookup.where("key = ':)' OR key = ''"), inline).collect())
    assert shown == sorted(["Ko đi vui  x", "Ko đi vui  x", "None", "", "ko KO akok"])


@pytest.mark.parametrize("inline", [1000, 0])
def test_null_words_change_nothing(spark, inline):
    rows = [(1, ["anh", "em", None, "xin"]), (1, ["anh", "em", None, "xin"]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id bigint, w array<string>")
    words = spark.createDataFrame([("anh",), (None,), ("anh",)], "word string")
    kept = sorted(str(r["w"]) for r in C.keep_tokens(df, "id", "w", words, 2, inline).collect())
    assert kept == sorted(["['em', 'xin']", "['em', 'xin']", "None", "[]"])
    gated = sorted((r["id"], r["gated_in"]) for r in S.has_opinion(df, "id", "w", words, inline).collect())
    assert gated == [(1, True), (1, True), (2, False), (3, False)]
