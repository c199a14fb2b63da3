"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Calls and results are hash-joined by (conversation, call id). A call may need the results of other calls.
Its order key is (wave, turn, number): waves start at 0, and a call's wave is at least that of each call that
it needs, one more where that call stands at or after it in the conversation. Sorting by the key is a
topological order that keeps the written order wherever dependencies allow. In well-formed conversations
all waves are 0 after one join; otherwise only calls whose wave rises are looked at again. Calls on or behind
a cycle are reported as such. Places are counted from blocks of turns, so that a conversation of any length
is spread over tasks.

Arguments are checked against schemas (tool, argument, type, required, choices), a dimension that is
broadcast if it is small. Canonical JSON has sorted keys, no white space and one way to write each value: numbers
are written from their text, without loss of digits (``canonical_number``). Only DataFrame functions are used.

Defined results: rows with a null conversation or call id link with nothing and are kept. If an id is used by
several calls of a conversation, the first by turn and number is the call, the others are "duplicate"; of
several results the first counts. Arguments that are null or no JSON object are "not an object". An argument
has the type of its JSON value, whatever its text looks like: "2" is a string, and null is of type "null" only.
An integer is a number written without fraction and exponent. A schema row whose type is null, or none of
JSON's, takes every value. A result without a call is "orphan", a call without a result "open". Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwire.llm.once import once
from siftwire.llm.sized import sized
from siftwire.session import checkpointed

CALL = "conv_id long, turn long, number int, call_id string, tool string, arguments string, needs array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
SCHEMA = "tool string, argument string, type string, required boolean, choices array<string>"

#: The tool that turns of plain conversations are read as: a user's turn asks for a reply.
REPLY_SCHEMA = [("reply", "prompt", "string", True, None), ("reply", "role", "string", True, ["user", "system"]), ("reply", "turn", "integer", True, None)]
#: Turns that are numbered together.
BLOCK = 64


def schema_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of plain turns (conv_id, turn, role, text).

    A user's turn calls ``reply``; the assistant's next turn is its result. A call needs that of two turns
    before, the user's last. Turns of other roles call ``reply`` too and need nothing.
    """
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    asks = turns.where(F.coalesce(F.col("role"), F.lit("")) != "assistant")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), F.col("role").alias("role"), F.col("turn").alias("turn")))
    before = F.when(F.col("role") == "user", F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = asks.select("conv_id", "turn", F.lit(0).alias("number"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), before.alias("needs"))
    answers = turns.where("role = 'assistant'")
    return calls, answers.select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with ``errors``: array<string>, sorted. Arguments that no schema row names are unknown."""
    rules = schemas.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("argument", "type", "required", "choices"))).alias("rules"))
    known = calls.join(sized(rules), "tool", "left")
    value = F.try_parse_json("arguments")
    given = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    # Texts and types of the top-level arguments.
    fields = F.from_json("arguments", "map<string,string>")
    typed = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))

    def problems(rule: Column) -> Column:
        raw, kind = F.try_element_at(fields, rule["argument"]), F.try_element_at(typed, rule["argument"])
        number = ~(kind.isin("STRING", "BOOLEAN", "VOID") | kind.startswith("ARRAY<") | kind.startswith("OBJECT<"))
        right = (
            F.when(rule["type"] == "string", kind == "STRING")
            .when(rule["type"] == "integer", number & raw.rlike(r"^-?(?:0|[1-9]\d*)$"))
            .when(rule["type"] == "number", number)
            .when(rule["type"] == "boolean", kind == "BOOLEAN")
            .when(rule["type"] == "null", kind == "VOID")
            .when(rule["type"] == "array", kind.startswith("ARRAY<"))
            .when(rule["type"] == "object", kind.startswith("OBJECT<"))
            .otherwise(F.lit(True))
        )
        there = F.array_contains(given, rule["argument"])
        return F.array_compact(
            F.array(
                F.when(rule["required"] & ~there, F.concat(F.lit("missing "), rule["argument"])),
                F.when(there & ~F.coalesce(right, F.lit(False)), F.concat(F.lit("type "), rule["argument"])),
                F.when(there & rule["choices"].isNotNull() & ~F.coalesce(F.array_contains(rule["choices"], raw), F.lit(False)), F.concat(F.lit("choice "), rule["argument"])),
            )
        )

    names = F.transform("rules", lambda r: r["argument"])
    unknown = F.transform(F.array_except(given, names), lambda a: F.concat(F.lit("unknown "), a))
    found = F.sort_array(F.concat(F.flatten(F.transform("rules", problems)), unknown))
    errors = (
        F.when(F.col("rules").isNull(), F.array(F.lit("no such tool")))
        .when(value.isNull() | ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.array(F.lit("not an object")))
        .otherwise(found)
    )
    return known.withColumn("errors", errors).drop("rules")


# The parts of a JSON text. Repeated groups are possessive: Java's other ones recurse, and overflow on long texts.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?"
_PARTS = rf'(?s){_STRING}|{_NUMBER}|[^"0-9-]++|.'
#: Zeros that a number may have after its digits, or between its point and them, before it gets an exponent.
ZEROS = 20


def canonical_number(text: Column) -> Column:
    """One text for each value of a JSON number: 1, 1.0 and 10e-1 are 1, and -0 is 0.

    Digits are kept, as many as there are. Up to ZEROS zeros are written out; numbers that need more have the
    form 1.5e30 or 1e-30. Exponents of more than 18 digits stay as they are written.
    """
    part = lambda pattern: F.regexp_extract(text, pattern, 1)
    exponent = F.when(part(r"[eE]\+?(-?\d+)") == "", F.lit(0).cast("long")).otherwise(part(r"[eE]\+?(-?\d+)").try_cast("long"))
    lead, fraction = part(r"^-?(\d+)"), part(r"\.(\d+)")

    def written(n: Column) -> Column:
        sign, digits, size, shift = n["sign"], n["digits"], F.length(n["digits"]), n["shift"]
        whole = size + shift  # digits before the point, if positive
        zeros = lambda count: F.repeat(F.lit("0"), count.cast("int"))
        rest = F.substring(digits, F.lit(2), size)
        return (
            F.when(digits == "", "0")
            .when((shift >= 0) & (shift <= ZEROS), F.concat(sign, digits, zeros(shift)))
            .when((shift < 0) & (whole > 0), F.concat(sign, F.substring(digits, F.lit(1), whole.cast("int")), F.lit("."), F.substring(digits, (whole + 1).cast("int"), size)))
            .when((shift < 0) & (whole > -ZEROS), F.concat(sign, F.lit("0."), zeros(-whole), digits))
            .otherwise(F.concat(sign, F.left(digits, F.lit(1)), F.when(size > 1, F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), (whole - 1).cast("string")))
        )

    def stripped(n: Column) -> Column:
        digits = F.rtrim(n["digits"], F.lit("0"))
        return once(F.struct(n["sign"].alias("sign"), digits.alias("digits"), (n["shift"] + F.length(n["digits"]) - F.length(digits)).alias("shift")), written)

    number = F.struct(
        F.when(text.startswith("-"), "-").otherwise("").alias("sign"),
        F.ltrim(F.concat(lead, fraction), F.lit("0")).alias("digits"),
        (F.when(F.abs(exponent) < 10**18, exponent) - F.length(fraction)).alias("shift"),
    )
    return once(number, lambda n: F.when(n["shift"].isNull() & (n["digits"] != ""), text).otherwise(stripped(n)))


def canonical_json(text: Column) -> Column:
    """The JSON text with sorted keys, no white space and one way to write each value; null where Spark reads no JSON.

    Numbers pass the parser as texts: every text is marked with s, every number with n, and the marks go at last.
    """
    parts = lambda c: F.regexp_extract_all(c, F.lit(_PARTS), F.lit(0))
    tail = lambda t, n: F.substring(t, F.lit(n), F.length(t))
    is_number = lambda t: t.rlike(r"^-?\d")
    marked = F.transform(parts(text), lambda t: F.when(t.startswith('"') & (F.length(t) > 1), F.concat(F.lit('"s'), tail(t, 2))).when(is_number(t), F.concat(F.lit('"n'), canonical_number(t), F.lit('"'))).otherwise(t))
    parsed = F.when(F.try_parse_json(text).isNotNull(), F.to_json(F.try_parse_json(F.array_join(marked, ""))))
    plain = F.transform(parts(parsed), lambda t: F.when(t.startswith('"s'), F.concat(F.lit('"'), tail(t, 3))).when(t.startswith('"n'), F.substring(t, F.lit(3), F.length(t) - 3)).otherwise(t))
    return F.array_join(plain, "")


def _waves(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, wave, cyclic) of the calls whose wave isn't 0; ``calls`` have unique ids."""
    at = F.struct("turn", "number")
    needs = calls.select("conv_id", F.col("call_id").alias("later"), at.alias("later_at"), F.explode("needs").alias("call_id"))
    edges = needs.join(calls.select("conv_id", "call_id", at.alias("at")), ["conv_id", "call_id"]).select(
        "conv_id", F.col("call_id").alias("first"), "later", F.when(F.col("at") < F.col("later_at"), 0).otherwise(1).alias("step")
    )
    rising = edges.where("step = 1").select("conv_id", F.col("later").alias("call_id"), F.lit(1).alias("wave")).distinct()
    rising = checkpointed(rising)
    state = rising
    if rising.isEmpty():
        return state.withColumn("cyclic", F.lit(False))
    # A wave above the number of backward needs of its conversation can only come from a cycle.
    edges = checkpointed(edges.join(sized(rising.select("conv_id").distinct()), "conv_id", "left_semi"))
    most = checkpointed(edges.where("step = 1").groupBy("conv_id").agg(F.count("*").alias("most")))
    while not rising.isEmpty():
        reached = rising.join(edges, (rising["conv_id"] == edges["conv_id"]) & (rising["call_id"] == edges["first"])).select(rising["conv_id"], F.col("later").alias("call_id"), (F.col("wave") + F.col("step")).alias("wave"))
        best = reached.groupBy("conv_id", "call_id").agg(F.max("wave").alias("new"))
        grown = best.join(state, ["conv_id", "call_id"], "left").where(F.col("new") > F.coalesce("wave", F.lit(0))).join(sized(most), "conv_id").where("new <= most + 1")
        rising = checkpointed(grown.select("conv_id", "call_id", F.col("new").alias("wave")))
        state = checkpointed(state.unionByName(rising).groupBy("conv_id", "call_id").agg(F.max("wave").alias("wave")))
    return state.join(sized(most), "conv_id").select("conv_id", "call_id", "wave", (F.col("wave") > F.col("most")).alias("cyclic"))


def _placed(rows: DataFrame) -> DataFrame:
    """``place``: the number of a row in its conversation by (wave, turn, number), counted over blocks of turns."""
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = rows.groupBy("conv_id", "wave", "block").agg(F.count("*").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("conv_id").orderBy("wave", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("conv_id", "wave", "block", F.coalesce(upto, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("conv_id", "wave", "block").orderBy("turn", "number", "call_id", "status"))
    numbered = rows.withColumn("within", within).withColumnRenamed("conv_id", "__conv").withColumnRenamed("wave", "__wave").withColumnRenamed("block", "__block")
    on = numbered["__conv"].eqNullSafe(starts["conv_id"]) & (numbered["__wave"] == starts["wave"]) & numbered["__block"].eqNullSafe(starts["block"])
    joined = numbered.join(starts.select("conv_id", "wave", "block", "start"), on)
    return joined.withColumn("place", (F.col("start") + F.col("within")).cast("long")).drop("__conv", "__block", "__wave", "within", "start", "block")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, place, status, errors, json) of every call, and of every result without one.

    ``json`` is the canonical message: arguments, call id, result, status and tool. Other columns of the inputs are left out.
    """
    calls, results, schemas = (df.select([f.split()[0] for f in fields.split(", ")]) for df, fields in ((calls, CALL), (results, RESULT), (schemas, SCHEMA)))
    key = ["conv_id", "call_id"]
    firsts = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).groupBy(*key).agg(F.min(F.struct("turn", "number")).alias("at"))
    marked = calls.join(firsts, key, "left").withColumn("first", F.coalesce(F.struct("turn", "number") == F.col("at"), F.lit(False))).drop("at")
    own = marked.where("first").drop("first")
    answer = results.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"))
    waves = _waves(own)
    linked = (
        validated(own, schemas)
        .join(answer, key, "left")
        .join(waves, key, "left")
        .withColumns({"wave": F.coalesce("wave", F.lit(0)), "status": F.when(F.coalesce("cyclic", F.lit(False)), "cyclic").when(F.col("answer").isNull(), "open").otherwise("linked"), "content": F.col("answer.content")})
    )
    none = F.array().cast("array<string>")
    columns = ["conv_id", "turn", "number", "call_id", "tool", "arguments", "errors", "wave", "status", "content"]
    repeated = marked.where("not first").withColumns({"errors": none, "wave": F.lit(0), "status": F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unnamed").otherwise("duplicate"), "content": F.lit(None).cast("string")})
    orphans = results.join(firsts, key, "left_anti").select(
        "conv_id", "turn", F.lit(0).alias("number"), "call_id", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("arguments"),
        none.alias("errors"), F.lit(0).alias("wave"), F.lit("orphan").alias("status"), "content",
    )
    rows = _placed(linked.select(columns).unionByName(repeated.select(columns)).unionByName(orphans))
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), "status", "tool"))
    arguments = canonical_json(F.col("arguments"))
    json = F.when(arguments.isNull(), rest).otherwise(F.concat(F.lit('{"arguments":'), arguments, F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))
    return rows.select("conv_id", "turn", "call_id", "place", "status", "errors", json.alias("json"))
