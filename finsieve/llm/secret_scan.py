"""Secrets in texts: regular expressions propose, a random forest removes false positives.

All of it is DataFrame expressions and Spark's own forest. A candidate is a long run
of key characters with a digit, or the value of an assignment to a name such as
``password``, up to its closing quote. A word may hold any number of candidates;
each has its place in the text and a score of its own. The forest sees the
candidate's length and characters, transitions between kinds of characters, how much
of it common words cover, whether it is part of a path, and the words before it. It
is trained from labelled findings: a table handed in, or the one made here by rule,
which takes keys of the usual alphabets and passwords in assignments as secrets, and
commits, checksums, identifiers, paths, numbers and placeholders as none.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.names import fresh
from finsieve.session import materialize

#: Labelled findings made by rule when none are handed in, and the size of the forest.
LABELLED_ROWS, TREES, DEPTH = 8_000, 40, 10
REDACTED = "[SECRET]"

_NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)"
WORDS = r"[\x20\x09-\x0D]+"
# Loops over groups are possessive: Java runs those without recursion, however long the text.
_SPACE, _QUOTE = r"[\x20\x09-\x0D]*+", r"\\*+[\"'`]"
#: A name and a sign, with what may stand between them and the value.
ASSIGNED = rf"(?i){_NAMES}[a-z0-9_-]*+(?:{_QUOTE})?[\])]?{_SPACE}(?:=>|:=|={{1,3}}|:){_SPACE}(?:bearer\x20++)?"
#: A run of key characters with a digit.
LONG_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=([A-Za-z0-9_+/-]{16,}+))"
#: A value between quotes, on one line.
QUOTED = rf"{ASSIGNED}({_QUOTE})(?=((?:(?!\1)(?:\\.|[^\\\n]))++)\1)"
#: A value up to white space, a quote or tag that ends it, or a separator and the next name.
PLAIN = rf"{ASSIGNED}(?:{_QUOTE})?(?=((?:(?!{_QUOTE}(?:[\s,;:)\]}}>&]|\z)|\\++[\"'`]|</?[A-Za-z]|[;,&][A-Za-z0-9_.%-]*+[=:]|(?:(?<![a-z0-9]){_NAMES}[a-z0-9_-]*+[=:]))\S)++))"
#: Marks in the working copy of a text: before a found value, and behind it.
_OPEN, _SHUT = "\x01", "\x02"
#: Characters before and behind a candidate that features look at.
CONTEXT = 200
#: A secret of so many characters is redacted at its other places in the text, too.
REPEATED = 8

# Words and pairs of letters that keys seldom have (fixed values).
COMMON_WORDS = (
    "account address admin article author book build change chapter client code config content data default demo document download dummy"
    " email error example file filter first folder form group hello here home house image index input item label last library line link"
    " list local login long main manager message method model module name node number object order output page paper part party password"
    " path person place placeholder point product project public record report request result sample school script search secret section"
    " server service session share source start state station status string system table test text theme time title token type update user"
    " usr value variable version view water week word work world year your"
).split()
COMMON_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
_CONTEXT = r"commit|sha|md5|checksum|digest|hash|uuid|guid|version|build|etag|revision|isbn|order|invoice|phone|card"
_PLACEHOLDER = r"example|sample|dummy|placeholder|changeme|your|xxxx|test|demo|1234"

FEATURES = [
    "length",
    "digits",
    "upper",
    "symbols",
    "distinct",
    "transitions",
    "pairs",
    "covered",
    "vowels",
    "hex",
    "number",
    "grouped",
    "path",
    "code",
    "parts",
    "spaced",
    "assigned",
    "quoted",
    "named",
    "password",
    "reference",
    "placeholder",
]


def _places(text: Column, pattern: str, group: int) -> Column:
    """Start (from 0), word number (from 1) and value of every match's ``group``, which looks ahead from the match's end."""
    rest_of = lambda p: F.substring_index(p, _SHUT, -1)

    def step(acc: Column, p: Column) -> Column:
        place = F.struct(acc["start"].alias("start"), acc["word_no"].alias("word_no"), F.substring_index(p, _SHUT, 1).alias("value"))
        return F.struct(
            (acc["start"] + F.char_length(rest_of(p))).alias("start"),
            (acc["word_no"] + F.regexp_count(rest_of(p), F.lit(WORDS))).alias("word_no"),
            F.when(F.contains(p, F.lit(_SHUT)), F.concat(acc["found"], F.array(place))).otherwise(acc["found"]).alias("found"),
        )

    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"$0{_OPEN}${group}{_SHUT}"))
    none = F.lit([]).cast("array<struct<start:int,word_no:int,value:string>>")
    zero = F.struct(F.lit(0).alias("start"), F.lit(1).alias("word_no"), none.alias("found"))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(F.split(marked, _OPEN), zero, step)["found"]).otherwise(none)


def values_of(text: Column) -> Column:
    """Every candidate of a text as ``start`` (from 0), ``word_no`` (from 1) and ``value``; equal ones once."""
    # one character each, so that places stay
    clean = F.when(F.rlike(text, F.lit(f"[{_OPEN}{_SHUT}]")), F.translate(text, _OPEN + _SHUT, "\x03\x03")).otherwise(text)
    # unquoted, the punctuation behind a value is not part of it
    plain = F.transform(_places(clean, PLAIN, 1), lambda x: x.withField("value", F.rtrim(x["value"], F.lit(".,;:)]}>"))))
    found = F.concat(_places(clean, LONG_RUN, 1), _places(clean, QUOTED, 2), plain)
    return F.array_distinct(F.filter(found, lambda x: F.length(F.trim(x["value"])) > 0))


def _share(value: Column, kind: str) -> Column:
    return F.regexp_count(value, F.lit(kind)) / F.greatest(F.length(value), F.lit(1))


def features(value: Column, left: Column, right: Column) -> dict[str, Column]:
    """The forest's view of a candidate ``value`` and of the text before and behind it."""
    size = F.greatest(F.length(value), F.lit(1))
    lower = F.lower(value)
    before = F.slice(F.reverse(F.split(left, WORDS)), 1, 3)
    context = F.lower(F.concat_ws(" ", F.reverse(before)))
    word = F.concat(F.get(before, F.lit(0)), value, F.get(F.split(right, WORDS, 2), F.lit(0)))
    yes = F.lit(1.0)
    return {
        "length": F.length(value).cast("double"),
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "symbols": _share(value, r"[^A-Za-z0-9\s]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "transitions": F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) / size,
        "pairs": F.regexp_count(lower, F.lit(f"(?={'|'.join(COMMON_PAIRS)})")) / size,
        "covered": 1 - F.length(F.regexp_replace(lower, "|".join(COMMON_WORDS), "")) / size,
        "vowels": _share(lower, "[aeiou]"),
        "hex": F.when(F.rlike(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), yes).otherwise(0.0),
        "number": F.when(F.rlike(value, F.lit("^[0-9+/.-]+$")), yes).otherwise(0.0),
        "grouped": F.when(F.rlike(lower, F.lit("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), yes).otherwise(0.0),
        "path": F.regexp_count(word, F.lit("://|/[A-Za-z._-]|[\\\\]")).cast("double"),
        "code": F.regexp_count(value, F.lit(r"[(){}\[\]<>$%]|::")) / size,
        "parts": F.regexp_count(value, F.lit("[A-Za-z]{3,}")).cast("double"),
        "spaced": _share(value, r"\s"),
        "assigned": F.when(F.rlike(left, F.lit(rf"[:=]>?{_SPACE}(?:{_QUOTE})?$")), yes).otherwise(0.0),
        "quoted": F.when(F.rlike(left, F.lit("[\"'`]$")) & F.rlike(right, F.lit(rf"^{_QUOTE}")), yes).otherwise(0.0),
        "named": F.when(F.rlike(context, F.lit(_NAMES)), yes).otherwise(0.0),
        "password": F.when(F.rlike(context, F.lit(r"(?:pass(?:word|wd)|pwd|secret|credential)[a-z0-9_-]*+[^a-z0-9]*+$")), yes).otherwise(0.0),
        "reference": F.when(F.rlike(context, F.lit(_CONTEXT)), yes).otherwise(0.0),
        "placeholder": F.when(F.rlike(lower, F.lit(_PLACEHOLDER)), yes).otherwise(0.0),
    }


def labelled_by_rule(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """``before_that, before, word, label``: made findings, half of them secrets."""
    steps: list[dict[str, Column]] = [{}, {}, {}]

    def made(step: int, name: str, x: Column) -> Column:
        # a column of its own, stored: written out in every finding, the plan takes the driver hundreds of MB
        steps[step][name] = x
        return F.col(name)

    def drawn(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))

    def hexes(n: int, salt: str = "h") -> Column:
        twice = F.concat(F.sha2(F.concat_ws(salt, F.lit(salt), "id"), 256), F.sha2(F.concat_ws(salt, F.lit("+" + salt), "id"), 256))
        return F.substring(twice, 1, n)

    def mixed(n: int, salt: str = "m") -> Column:
        return F.substring(F.regexp_replace(F.base64(F.unhex(hexes(128, salt))), "[^A-Za-z0-9]", "x"), 1, n)

    def one_of(choices: list[str], salt: str) -> Column:
        return F.element_at(F.array(*map(F.lit, choices)), (drawn(salt, len(choices)) + 1).cast("int"))

    common = made(0, "common", one_of(COMMON_WORDS, "c1"))
    other = made(0, "other", one_of(COMMON_WORDS, "c2"))
    third = made(0, "third", one_of(COMMON_WORDS, "c3"))
    name = made(0, "name", one_of(["token", "secret", "api_key", "password", "access_key", "auth_token", "API_KEY", "SECRET", "TOKEN", "client_secret"], "n"))
    sign = made(0, "sign", one_of(["=", ":"], "s"))
    tail = made(0, "tail", one_of(["", "", "", ".", ",", "###", "!!", "&&&"], "t"))
    number = made(0, "number", F.conv(hexes(14, "d"), 16, 10))

    def spoken(n: int, salt: str) -> Column:
        letters = [one_of(list("bcdfghklmnprstvw" if i % 2 == 0 else "aeiou"), f"{salt}{i}") for i in range(n)]
        return F.concat(*letters)

    any_word = made(1, "any_word", F.when(drawn("a", 2) == 0, common).otherwise(spoken(6, "y")))
    short = made(2, "short", F.concat(any_word, F.substring(number, F.lit(1), (drawn("sd", 3) + 1).cast("int"))))
    hard = made(2, "hard", F.concat(F.initcap(any_word), one_of(list("@#$&!%_"), "q"), F.substring(number, 2, 2), spoken(3, "z"), one_of(["!", "?", "!Q", "*", "$9"], "w")))
    pass_name = made(0, "pass_name", one_of(["password", "db_password", "passwd", "pwd", "DB_PASSWORD", "secret", "client_secret", "user_pwd"], "pn"))
    letters = made(0, "letters", F.translate(mixed(64, "l"), "0123456789", "qWzKxJvYhG"))
    link = one_of(["-", "_", ".", "-", "-"], "lk")
    phrase = made(2, "phrase", F.concat(spoken(7, "p"), link, any_word, link, spoken(5, "r")))
    symbolic = made(1, "symbolic", F.concat(F.substring(letters, 1, 3), one_of(list("@#$&!%-"), "q"), F.substring(letters, 5, 4), one_of(list("!?*#^~"), "w"), F.substring(letters, 12, 3)))
    json_name = F.concat(F.lit('{"id":"'), common, F.lit('","'), name, F.lit('":"'))
    empty = F.lit("")

    def quoted(x: Column) -> Column:
        return F.concat(F.lit('"'), x, F.lit('"'), tail)

    secrets = [
        (name, sign, quoted(hexes(40))),
        (common, other, F.concat(name, sign, hexes(18), tail)),
        (name, sign, quoted(mixed(32))),
        (common, F.concat(name, F.lit(":")), F.concat(mixed(24), tail)),
        (common, other, F.concat(F.lit("AKIA"), F.upper(mixed(16)), tail)),
        (other, empty, F.concat(F.lit("ghp_"), mixed(36), tail)),
        (F.lit("Authorization:"), F.lit("Bearer"), F.concat(mixed(40), tail)),
        (F.upper(name), sign, quoted(F.upper(hexes(40)))),
        (empty, empty, F.concat(pass_name, sign, short)),
        (common, other, F.concat(pass_name, sign, short, tail)),
        (common, other, F.concat(pass_name, sign, hard)),
        (common, other, F.concat(pass_name, sign, quoted(hard))),
        (common, other, F.concat(F.lit('{"'), pass_name, F.lit('":"'), short, F.lit('"}'))),
        (common, other, F.concat(json_name, F.substring(mixed(32), 1, 32), F.lit('"}'))),
        (common, other, F.concat(name, sign, F.substring(mixed(32), 1, 8))),
        # without a digit, and over several words
        (name, one_of(["=", ":", ":=", "=>"], "s2"), quoted(F.substring(letters, F.lit(1), (drawn("ll", 24) + 9).cast("int")))),
        (common, F.concat(pass_name, F.lit(":")), F.concat(phrase, tail)),
        (common, other, F.concat(pass_name, sign, F.substring(letters, F.lit(1), (drawn("ll", 24) + 9).cast("int")))),
        (common, other, F.concat(pass_name, sign, symbolic)),
        (pass_name, one_of(["=", ":", ":=", "=>"], "s2"), F.concat(symbolic, tail)),
        (pass_name, one_of(["=", ":", ":=", "=>"], "s2"), quoted(phrase)),
        (pass_name, one_of(["=", ":", ":=", "=>"], "s2"), short),
    ]
    others = [
        (common, one_of(["commit", "sha1", "revision", "digest"], "r"), F.concat(hexes(40), tail)),
        (one_of(["uuid", "guid", "request", "session"], "u"), one_of(["", ":", "="], "e"), F.concat_ws("-", hexes(8), hexes(4, "b"), hexes(4, "c"), hexes(4, "e"), hexes(12, "f"))),
        (one_of(["checksum", "sha256", "md5", "hash"], "k"), one_of(["", ":", "="], "e"), F.concat(hexes(64), tail)),
        (common, other, F.concat(F.lpad(number, 16, "4"), tail)),
        (common, other, F.concat(F.lit("/"), common, F.lit("/"), other, F.lit("/"), third, (drawn("p", 100)).cast("string"))),
        (common, other, F.concat(F.lit("https://www."), common, F.lit(".example.com/"), other, F.lit("/"), number)),
        (name, sign, quoted(F.concat(one_of(["your_", "example-", "xxxxxxxx", "test_", "CHANGEME_"], "x"), name, F.lit("_here_1234")))),
        (common, other, F.concat_ws("_", common, other, third, drawn("v", 100).cast("string"))),
        (common, other, F.concat(F.lit("max_tokens"), sign, F.substring(number, 1, 4))),
        (common, other, F.concat(one_of(["author", "tokenizer", "authority", "token_type"], "au"), sign, any_word, F.substring(number, 1, 1))),
        (common, other, F.concat(name, sign, quoted(F.concat(one_of(["${", "<", "$(", "{{"], "br"), F.upper(name), F.lit("2"), one_of(["}", ">", ")", "}}"], "br"))))),
        (common, other, F.concat(name, sign, F.lit("$"), F.upper(name), F.lit("_1"))),
        (common, other, F.concat(name, sign, common, one_of(["[0]", "(1)", ".get(0)", "[1]"], "cd"))),
        (common, other, F.concat(name, sign, one_of(["test", "example", "dummy", "changeme"], "pl"), F.lit("1234"))),
        # prose, code and settings without a digit
        (common, F.concat(one_of(["password", "token", "secret", "auth", "credentials", "author", "tokens"], "pr"), F.lit(":")), any_word),
        (common, F.concat(one_of(["password", "token", "secret", "author", "secrets"], "pr"), F.lit(":")), F.concat(F.initcap(any_word), one_of(["", ".", ",", "?"], "en"))),
        (name, one_of(["=", ":", ":=", "=>"], "s2"), one_of(["None", "null", "true", "false", "string", "String", "str", "required", "undefined", "NULL", "optional", "nil"], "no")),
        (name, sign, F.concat(common, F.lit("."), other, one_of(["", "()", ".value", "[key]"], "co"))),
        (name, sign, F.concat(one_of(["get_", "os.environ[", "read_", "self.", "config."], "ge"), common, one_of(["", "()", "]"], "co"))),
        (name, sign, F.concat(one_of(["${", "<", "$(", "{{"], "br"), F.upper(name), one_of(["}", ">", ")", "}}"], "br"))),
        (name, sign, quoted(F.concat(one_of(["your", "my", "the", "enter", "insert"], "yo"), one_of(["-", "_", " "], "lk2"), common, one_of(["-", "_", " "], "lk2"), one_of(["here", "password", "token", "secret"], "he")))),
    ]
    kinds = [(*x, 1.0) for x in secrets] + [(*x, 0.0) for x in others]
    kind = F.pmod("id", F.lit(len(kinds)))
    rows_of = F.array(*(F.struct(a.alias("before_that"), b.alias("before"), w.alias("word"), F.lit(label).alias("label")) for a, b, w, label in kinds))
    source = spark.range(rows)
    for columns in steps:
        source = source.withColumns(columns)
    source = materialize(source, "made-parts")
    return source.select(F.element_at(rows_of, (kind + 1).cast("int")).alias("x")).select("x.*")


def _with_features(found: DataFrame) -> DataFrame:
    named = features(F.col("value"), F.col("left"), F.col("right"))
    return found.withColumn("features", array_to_vector(F.array(*(named[f].cast("double") for f in FEATURES))))


def _with_context(found: DataFrame, *rest: str) -> DataFrame:
    """``rest, word_no, start, value, left, right`` of the candidates ``at`` of ``text``."""
    start, value = F.col("at.start"), F.col("at.value")
    first = F.greatest(start - CONTEXT, F.lit(0))
    return found.select(
        *rest,
        F.col("at.word_no").alias("word_no"),
        start.alias("start"),
        value.alias("value"),
        F.substring("text", first + 1, start - first).alias("left"),
        F.substring("text", start + F.char_length(value) + 1, F.lit(CONTEXT)).alias("right"),
    )


def _labelled_candidates(labelled: DataFrame) -> DataFrame:
    """The candidates in the words of labelled findings; a word without one is its own."""
    head = F.concat(F.coalesce("before_that", F.lit("")), F.lit(" "), F.coalesce("before", F.lit("")), F.lit(" "))
    texts = labelled.select("label", F.char_length(head).alias("n"), "word", F.concat(head, "word").alias("text")).filter("word IS NOT NULL")
    own = F.filter(values_of(F.col("text")), lambda x: x["start"] >= F.col("n"))
    texts = texts.select("*", F.explode(F.array(own)).alias("found"))
    whole = F.array(F.struct(F.col("n").alias("start"), F.lit(3).alias("word_no"), F.col("word").alias("value")))
    return _with_context(texts.select("label", "text", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(whole)).alias("at")), "label")


def fit_forest(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest from ``labelled`` (``before_that, before, word, label``); it is learned on all rows handed in."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7)
    # step by step: in one plan the driver takes hundreds of MB to compile it
    found = materialize(_labelled_candidates(materialize(labelled, "labelled-words")), "labelled-candidates")
    return forest.fit(materialize(_with_features(found).select("features", "label"), "labelled-findings"))


_ADDED = ("word_no", "start", "value", "left", "right", "at", "features", "score", "is_secret", "probability", "rawPrediction", "prediction")


def candidates(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``word_no, start, value, left, right`` of every candidate."""
    rest = [c for c in docs.columns if c != "text" and c not in _ADDED]
    # most texts have no candidate at all and are not looked at again
    some = docs.filter(F.rlike("text", F.lit(LONG_RUN)) | F.rlike("text", F.lit(PLAIN)) | F.rlike("text", F.lit(QUOTED)))
    return _with_context(some.select(*rest, "text", F.explode(values_of(F.col("text"))).alias("at")), *rest)


def scan(docs: DataFrame, forest: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """Every candidate of ``docs`` (``text`` and more): ``word_no`` (from 1), ``start`` (in characters, from 0), ``value``, ``score`` (0 to 1), ``is_secret``.

    The other columns of ``docs`` are carried along, except those of these names.
    Null and empty texts have none; a value that repeats in a text is found each
    time, and candidates may overlap; an empty table gives no rows.
    """
    rest = [c for c in docs.columns if c != "text" and c not in _ADDED]
    found = _with_features(materialize(candidates(docs.select(*rest, "text")), "secret-candidates"))
    scored = forest.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*rest, "word_no", "start", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def _without(text: Column, secrets: Column) -> Column:
    """``text`` with ``[SECRET]`` for each stretch that ``secrets`` (``start, value``) cover, and for long values at their other places."""
    here = F.filter(secrets, lambda x: F.substring(text, x["start"] + 1, F.char_length(x["value"])) == x["value"])

    def step(acc: Column, x: Column) -> Column:
        new = (x["start"] >= acc["end"]) | (acc["end"] == 0)
        parts = F.array(F.substring(text, acc["end"] + 1, x["start"] - acc["end"]), F.lit(REDACTED))
        return F.struct(
            F.greatest(acc["end"], x["start"] + F.char_length(x["value"])).alias("end"),
            F.when(new, F.concat(acc["parts"], parts)).otherwise(acc["parts"]).alias("parts"),
        )

    zero = F.struct(F.lit(0).alias("end"), F.lit([]).cast("array<string>").alias("parts"))
    by_place = F.aggregate(
        F.array_sort(here), zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["end"] + 1, F.char_length(text)))
    )
    long = F.filter(F.array_distinct(F.transform(here, lambda x: x["value"])), lambda v: F.char_length(v) >= REPEATED)
    # longer values first, so that a value inside another does not split it
    ordered = F.array_sort(long, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(ordered, by_place, lambda t, v: F.replace(t, v, F.lit(REDACTED)))


def redact(docs: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``, and ``n_chars``, where there is one, counted again.

    No row goes, and columns of any name are kept. Secrets go back to their texts
    by the text's hash; a foreign one in case of a collision does not stand at its
    place and changes nothing. Null and empty texts stay as they are, repeated rows
    are treated alike, and an empty table gives no rows.
    """
    key, places = fresh("_text_hash", docs.columns), fresh("_secrets", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = scan(keyed.select(key, "text").filter("text IS NOT NULL"), forest).filter("is_secret")
    secrets = materialize(found.groupBy(key).agg(F.collect_set(F.struct("start", "value")).alias(places)), "secrets")
    joined = keyed.join(secrets, key, "left")
    joined = joined.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(places))))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return joined.select(*docs.columns)
