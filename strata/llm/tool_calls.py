"""Tool calls of chats: link calls and results, order them, check arguments against schemas, write canonical JSON."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strata.llm.components import connected_components, cut

#: Dependencies of connected calls that one task orders in memory; larger groups are ordered in rounds of joins.
IN_TASK = 200_000

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"

KEPT = ["node", "conv_id", "call_id", "again", "call_turn", "call_place", "result_turn", "after", "n_calls", "n_results"]

_SURROGATE = re.compile("[\ud800-\udfff]")

# The types of JSON schemas, with the Python types of parsed JSON.
_TYPES = {
    "string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),),
}


def escaped(text: str) -> str:
    """Lone surrogates, which no UTF-8 text can hold, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON without white space, keys sorted by code point, characters unescaped where JSON and UTF-8 allow it."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"no finite number: {text}")
    return value


def parsed(text: str):
    """JSON by the standard: NaN, Infinity and numbers beyond doubles are refused."""
    return json.loads(text, parse_float=_number, parse_constant=_number)


def _same(a, b) -> bool:
    """Equal as JSON: true is not 1, but 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES.get(kind, (object,))) or kind == "integer" and isinstance(value, float) and value.is_integer()


def violations(value, schema: dict, at: str = "") -> list[str]:
    """What a value breaks of a schema's type, enum, minimum, maximum, maxLength, required, properties,
    additionalProperties and items; other keywords are ignored.
    """
    here, found = at or "arguments", []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{here}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        found.append(f"{here}: not among the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{here}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        found += [f"{here}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        found.append(f"{here}: longer than {schema['maxLength']}")
    if isinstance(value, dict):
        inner = schema.get("properties", {})
        path = f"{at}." if at else ""
        found += [f"{path}{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in inner:
                found += violations(value[k], inner[k], path + k)
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += violations(item, schema["items"], f"{here}[{i}]")
    return found


def _checked(schemas: dict[str, dict]):
    """Errors and canonical JSON of each linked call."""

    def one(row: dict) -> tuple[list[str], str]:
        errors, arguments = [], None
        if row["call_turn"] is not None:
            try:
                arguments = parsed(row["arguments"]) if row["arguments"] is not None else None
                canonical(arguments)
                known = schemas.get(row["name"])
                errors = [f"unknown tool: {row['name']}"] if known is None else violations(arguments, known)
            except (ValueError, RecursionError):
                arguments, errors = row["arguments"], ["arguments: not JSON"]
        return [escaped(e) for e in errors], canonical({"arguments": arguments, "id": row["call_id"], "name": row["name"], "result": row["result"]})

    def run(batches):
        for batch in batches:
            found = [one(row) for row in batch.select(["call_id", "call_turn", "name", "arguments", "result"]).to_pylist()]
            columns = [batch.column(n) for n in kept] + [pa.array([e for e, _ in found], pa.list_(pa.string())), pa.array([j for _, j in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "errors", "json"])

    kept = KEPT
    return run


def link_calls(messages: DataFrame, schemas: dict[str, dict], most_steps: int | None = None, in_task: int = IN_TASK) -> DataFrame:
    """The earliest call and the earliest result of each id: `link_every_call` keeps the others, too.

    One row per (conv_id, call_id), with the columns of `link_every_call`; n_calls and n_results tell of what is left
    out. Calls without an id are rows of their own, results without one are dropped. `most_steps` has no effect; it
    bounded the order once.
    """
    calls, results = _parsed(messages)
    key = ["conv_id", "call_id"]
    first = calls.where("call_id IS NOT NULL").groupBy(*key).agg(F.min("call").alias("call"), F.count("*").alias("n_calls"))
    first = first.unionByName(calls.where("call_id IS NULL").withColumn("n_calls", F.lit(1).cast("long")))
    answer = results.where("call_id IS NOT NULL").groupBy(*key).agg(F.min("result").alias("result"), F.count("*").alias("n_results"))
    answer = answer.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), "result", "n_results")
    linked = first.join(answer, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
    linked = linked.withColumn("conv_id", F.when(F.col("call").isNull(), F.col("r_conv")).otherwise(F.col("conv_id")))
    return _finished(linked.withColumn("call_id", F.coalesce("call_id", "r_id")).withColumn("again", F.lit(False)), schemas, in_task)


def link_every_call(messages: DataFrame, schemas: dict[str, dict], in_task: int = IN_TASK) -> DataFrame:
    """One row per call, and per result that answers no call first, of messages (conv_id, turn, role, text).

    Assistant texts with `{"tool_calls": [{"id", "name", "arguments", "after"}]}` make calls; tool texts with
    `{"tool_call_id", "content"}` are results. Other texts, broken JSON and null texts make nothing. Columns:

    conv_id, call_id, call_turn, result_turn; n_calls, n_results: how often the conversation calls and answers the id;
    status: linked, early (the result comes before its call), unanswered, orphan (no call), repeated (a further result
    of a call that has one) or cycle; order_turn, order_step: sorted by these and call_place, a conversation's calls
    come after all that their `after` names; errors: what the arguments break of the tool's schema; json: canonical
    JSON.

    An id may be called again: the results up to the turn of its next call belong to the call before. Where a turn
    calls an id several times, its calls take these results one by one. Results before the first call are early, if
    it has none of its own, or orphans. Calls and results without an id are rows of their own, unanswered and orphan.
    A null conversation is one like others: no row of it is lost, but its pairs go by turns only. Rows of one
    (conversation, id) meet in one task, sorted on disk if need be; a long conversation is spread over tasks by its ids.

    A name in `after` means the latest such call up to the own turn that is not the call itself, else the first such
    call; names that are not called are ignored. Dependencies are followed to their end, however long. Only calls
    that come after themselves, over others or at once, are a cycle: what they need of each other is left out of the
    order, and calls that need one of them come after it like after any other.
    """
    calls, results = _parsed(messages, whole=True)
    none = F.lit(None)
    events = calls.where("call_id IS NOT NULL").withColumn("result", none).unionByName(results.where("call_id IS NOT NULL").withColumn("call", none))
    is_call = F.col("call").isNotNull()
    turn = F.coalesce("call.turn", "result.turn")
    events = events.withColumn("kind", F.when(is_call, 0).otherwise(1)).withColumn("turn", turn)
    key = Window.partitionBy("conv_id", "call_id")
    at = key.orderBy("turn", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.when(is_call, F.struct("turn"))
    events = events.select("*", F.last(block, True).over(at).alias("block"))
    events = events.select(
        "*", F.min(block).over(key).alias("head"), F.count("call").over(key).alias("n_calls"), F.count("result").over(key).alias("n_results"),
    )
    answered = F.max(F.col("result").isNotNull() & F.col("block").eqNullSafe(F.col("head"))).over(key)
    events = events.withColumn("block", F.when(F.col("block").isNull() & ~answered, F.col("head")).otherwise(F.col("block")))
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id", "block", "kind").orderBy("turn", "call", "result"))
    pairs = events.withColumn("nth", nth).groupBy("conv_id", "call_id", "block", "nth")
    linked = pairs.agg(*[F.max(c).alias(c) for c in ("call", "result", "n_calls", "n_results")]).withColumn("again", F.col("block").isNotNull())
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    unnamed = calls.where("call_id IS NULL").select("*", none.alias("result"), one.alias("n_calls"), zero.alias("n_results"))
    unnamed = unnamed.unionByName(results.where("call_id IS NULL").select("*", none.alias("call"), zero.alias("n_calls"), one.alias("n_results")))
    return _finished(linked.drop("block", "nth").unionByName(unnamed.withColumn("again", F.lit(False))), schemas, in_task)


def _parsed(messages: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """`conv_id`, `call_id` and `call` or `result`; only if `whole`, results without an id are sure to be results."""
    parsed = messages.select("conv_id", "turn", "role", "text")
    calls = parsed.where("role = 'assistant'").select("conv_id", "turn", F.from_json("text", _CALLS)["tool_calls"].alias("c"))
    calls = calls.select("conv_id", "turn", F.posexplode("c").alias("place", "c")).where("c IS NOT NULL")
    call = F.struct("turn", "place", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), call.alias("call"))
    results = parsed.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", _RESULT).alias("r"), "text")
    if whole:
        results = results.where(F.col("r.tool_call_id").isNotNull() | F.arrays_overlap(F.json_object_keys("text"), F.array(F.lit("content"), F.lit("tool_call_id"))))
    results = results.select("conv_id", F.col("r.tool_call_id").alias("call_id"), F.struct("turn", F.col("r.content").alias("content")).alias("result"))
    return calls, results


def _finished(linked: DataFrame, schemas: dict[str, dict], in_task: int) -> DataFrame:
    """Checks, order and status of paired calls and results; `again`: results without a call are further ones."""
    none = F.lit(0).cast("long")
    linked = linked.select(
        "conv_id", "call_id", "again",
        F.col("call.turn").alias("call_turn"), F.col("call.place").alias("call_place"), F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"), F.col("call.after").alias("after"),
        F.col("result.turn").alias("result_turn"), F.col("result.content").alias("result"),
        F.coalesce("n_calls", none).alias("n_calls"), F.coalesce("n_results", none).alias("n_results"),
    )
    linked = linked.withColumn("node", F.monotonically_increasing_id())
    kinds = {f.name: f.dataType for f in linked.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in KEPT]).add("errors", T.ArrayType(T.StringType())).add("json", T.StringType())
    done = cut(linked.mapInArrow(_checked(schemas), schema))

    moved = _orders(done, in_task)
    found = done.withColumn("order_turn", F.coalesce("call_turn", "result_turn")).withColumn("order_step", F.lit(0))
    if moved is not None:
        found = found.join(moved, "node", "left")
        found = found.withColumn("order_turn", F.coalesce("turn", "order_turn")).withColumn("order_step", F.coalesce("step", "order_step"))
    cyclic = F.coalesce("cyclic", F.lit(False)) if moved is not None else F.lit(False)
    status = F.when(cyclic, "cycle").when(F.col("call_turn").isNull() & F.col("again"), "repeated").when(F.col("call_turn").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered")
    status = status.when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    return found.select("conv_id", "call_id", "call_turn", "call_place", "result_turn", "n_calls", "n_results", status.alias("status"), "order_turn", "order_step", "errors", "json")


def _orders(done: DataFrame, in_task: int) -> DataFrame | None:
    """`node`, `turn`, `step`, `cyclic` of the calls in groups where one has to move behind what it comes after."""
    own = F.struct(F.col("call_turn").cast("long").alias("turn"), F.lit(0).alias("step"), F.col("call_place").cast("long").alias("place"))
    calls = done.where("call_turn IS NOT NULL").select("node", "conv_id", "call_id", "after", own.alias("at"))
    needs = calls.select("node", "conv_id", "at", "call_id", F.explode(F.array_distinct("after")).alias("before")).where("before IS NOT NULL")
    # In a turn, its calls in their places; before each of them, its need of its own name; after all, needs of other names.
    mine = F.col("before") == F.coalesce("call_id", F.lit(""))
    place = F.when(mine, F.col("at.place")).otherwise(F.lit((1 << 63) - 1))
    side = F.when(mine, F.lit(0)).otherwise(F.lit(2))
    needs = needs.select("conv_id", "before", "node", "at", place.alias("place"), side.alias("side"), F.lit(None).alias("known"))
    known = calls.where("call_id IS NOT NULL").select(
        "conv_id", F.col("call_id").alias("before"), "node", "at", F.col("at.place").alias("place"), F.lit(1).alias("side"), F.struct("at", "node").alias("known")
    )
    key = Window.partitionBy("conv_id", "before")
    up_to = key.orderBy("at.turn", "place", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = needs.unionByName(known).select("node", "at", "side", F.coalesce(F.last("known", True).over(up_to), F.min("known").over(key)).alias("met"))
    edges = cut(met.where("side != 1 AND met IS NOT NULL").select("node", F.col("met.node").alias("need"), "at", F.col("met.at").alias("need_at")))
    if edges.where("need_at >= at").isEmpty():
        return None
    roots = connected_components(edges, "node", "need").withColumnRenamed("node", "member")
    grouped = edges.join(roots, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node")).drop("member")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"), F.max(F.col("need_at") >= F.col("at")).alias("late")).where("late").drop("late")
    grouped = cut(grouped.join(sizes, "root"))
    small = grouped.where(F.col("n") <= in_task).repartition("root").sortWithinPartitions("root")
    small = small.select("root", "node", "need", *[F.col(f"{a}.{f}").alias(f"{a}_{f}") for a in ("at", "need_at") for f in ("turn", "place")])
    moved = small.mapInArrow(_groups, "node long, turn long, step int, cyclic boolean")
    large = grouped.where(F.col("n") > in_task).select("node", "need", "at", "need_at")
    return cut(moved if large.isEmpty() else moved.unionByName(_in_rounds(cut(large))))


def settle(at: dict[int, tuple], needs: dict[int, list[int]]) -> dict[int, tuple]:
    """Turn, step and whether it is on a cycle, of each call: Tarjan's strongly connected groups come out needs first."""
    number, low, open_, stack, to, found = {}, {}, set(), [], {}, {}
    for start in at:
        work = [start] if start not in number else []
        rest = {}
        while work:
            v = work[-1]
            if v not in number:
                number[v] = low[v] = len(number)
                stack.append(v)
                open_.add(v)
                rest[v] = iter(needs.get(v, ()))
            for w in rest[v]:
                if w not in number:
                    work.append(w)
                    break
                if w in open_:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1]] = min(low[work[-1]], low[v])
                if low[v] == number[v]:
                    group = {stack.pop()}
                    while v not in group:
                        group.add(stack.pop())
                    open_ -= group
                    cyclic = len(group) > 1 or v in needs.get(v, ())
                    for m in group:
                        last = max((to[w] for w in needs.get(m, ()) if w not in group), default=None)
                        to[m] = at[m] if last is None or last < at[m] else (last[0], last[1] + 1, 0)
                        found[m] = (to[m][0], to[m][1], cyclic)
    return found


def _groups(batches):
    """`settle` for each run of rows with the same root."""
    root, at, needs = None, {}, {}

    def settled():
        found = settle(at, needs)
        columns = [list(found), *(zip(*found.values(), strict=True))]
        kinds = {"node": pa.int64(), "turn": pa.int64(), "step": pa.int32(), "cyclic": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    for batch in batches:
        for key, node, need, turn, place, need_turn, need_place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != root and at:
                yield settled()
                at, needs = {}, {}
            root = key
            at[node], at[need] = (turn, 0, place), (need_turn, 0, need_place)
            needs.setdefault(node, []).append(need)
    if at:
        yield settled()


def _in_rounds(edges: DataFrame) -> DataFrame:
    """What `settle` gives, in rounds of joins until nothing moves: as many as the longest chain of moves."""
    cycles = _cycles(edges)
    ends = edges.join(cycles.select(F.col("node"), F.col("cycle").alias("a")), "node", "left")
    ends = ends.join(cycles.select(F.col("node").alias("need"), F.col("cycle").alias("b")), "need", "left")
    edges = cut(ends.where("a IS NULL OR b IS NULL OR a != b").drop("a", "b"))
    behind = F.struct(F.col("need_at.turn").alias("turn"), (F.col("need_at.step") + 1).alias("step"), F.lit(0).cast("long").alias("place"))
    moved = None
    while not (change := cut(edges.where("need_at >= at").groupBy("node").agg(F.max(behind).alias("to")))).isEmpty():
        moved = change if moved is None else cut(moved.unionByName(change).groupBy("node").agg(F.max("to").alias("to")))
        edges = edges.join(change, "node", "left").withColumn("at", F.coalesce("to", "at")).drop("to")
        edges = edges.join(change.withColumnRenamed("node", "need"), "need", "left").withColumn("need_at", F.coalesce("to", "need_at")).drop("to")
        edges = cut(edges)
    cyclic = cycles.select("node").withColumn("cyclic", F.lit(True))
    if moved is None:
        return cyclic.select("node", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("int").alias("step"), "cyclic")
    found = moved.join(cyclic, "node", "full")
    return found.select("node", F.col("to.turn").alias("turn"), F.col("to.step").cast("int").alias("step"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def _cycles(edges: DataFrame) -> DataFrame:
    """`node`, `cycle`: the strongly connected groups of more than one call and the calls that need themselves.

    Ends are peeled off; then each call takes the largest number it reaches, and those of one number that are
    reached from it are a group. Groups are taken off until no dependency is left.
    """
    found = edges.where("node = need").select("node", F.col("node").alias("cycle")).distinct()
    rest, n = cut(edges.where("node != need").select("node", "need").distinct()), None
    while True:
        while (now := rest.count()) != n:
            n = now
            inner = rest.join(rest.select(F.col("node").alias("need")).distinct(), "need", "left_semi")
            rest = cut(inner.join(rest.select(F.col("need").alias("node")).distinct(), "node", "left_semi").select("node", "need"))
        if not n:
            return cut(found.groupBy("node").agg(F.max("cycle").alias("cycle")))
        color, changed = cut(rest.select("node").distinct().withColumn("color", F.col("node"))), True
        while changed:
            reached = rest.join(color.withColumnRenamed("node", "need"), "need").groupBy("node").agg(F.max("color").alias("far"))
            new = cut(color.join(reached, "node", "left").select("node", F.greatest("color", "far").alias("color"), (F.col("far") > F.col("color")).alias("up")))
            changed = not new.where("up").isEmpty()
            color = new.drop("up")
        inside = rest.join(color, "node").join(color.select(F.col("node").alias("need"), F.col("color").alias("other")), "need")
        inside = cut(inside.where("color = other").select("node", "need", "color"))
        group, front = color.where("node = color"), color.where("node = color")
        while not front.isEmpty():
            after = inside.join(front.select("node"), "node").select(F.col("need").alias("node"), "color").distinct()
            front = cut(after.join(group.select("node"), "node", "left_anti"))
            group = cut(group.unionByName(front))
        many = group.groupBy("color").count().where("count > 1").select("color")
        found = cut(found.unionByName(group.join(many, "color", "left_semi").select("node", F.col("color").alias("cycle"))))
        gone = group.select("node")
        rest = rest.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "need"), "need", "left_anti")
        rest, n = cut(rest.select("node", "need")), None
