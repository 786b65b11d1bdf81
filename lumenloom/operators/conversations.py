"""Conversations as arrays of typed messages: counts, patterns, and conversion into training rows.

A message is a struct with role, type and text. Conversion walks a message
array once from left to right with an accumulator, because it consumes messages
greedily: what a match has used up can't begin another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.geometry import to_thousandths, within_tolerance
from lumenloom.functions.values import bound, clean_text

#: Type of a message in an array: `collect` and `convert` expect it.
MESSAGE = "struct<role:string,type:string,text:string>"


def collect(messages: DataFrame, conv: str, order: str) -> DataFrame:
    """One row per conversation: conv and messages, ordered. Conversations are short; one is held as a whole."""
    return messages.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "role", "type", "text"))), lambda m: F.struct(m["role"], m["type"], m["text"]).cast(MESSAGE)).alias("messages"))


def type_counts(messages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Messages per type; a missing type counts as <missing>."""
    return messages.groupBy(*keys, F.coalesce("type", F.lit("<missing>")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def next_patterns(messages: DataFrame, conv: str, order: str) -> DataFrame:
    """How often a type is followed by which one and two; for detection, not for conversion."""
    w = Window.partitionBy(conv).orderBy(order)
    return messages.withColumns({"next1": F.lead("type", 1).over(w), "next2": F.lead("type", 2).over(w)}).groupBy("type", "next1", "next2").agg(F.count(F.lit(1)).alias("n"))


#: Images shown in a conversation, and what `exact_calls` takes of a message.
SHOWN = "array<struct<presented_img_idx:int,kind:string,parent_presented_img_idx:int,bbox_on_presented:array<double>,display_size:array<double>>>"
CALLING = "array<struct<role:string,type:string,call:string,presented:array<int>>>"
# Fixed value: the tool that the calls name.
ZOOM = "image_zoom_in_tool"


def _variant(value: Column, path: str, kind: str) -> Column:
    """A member of a variant if it has the JSON type that `kind` (string, number, array, object) names, else null."""
    part = F.try_variant_get(value, path, "variant")

    def typed(p: Column) -> Column:
        return F.when(_has_type(F.schema_of_variant(p), kind), p)

    return bound(part, typed)


def _has_type(schema: Column, kind: str) -> Column:
    return {
        "string": schema == "STRING", "integer": schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$|^DECIMAL\\([0-9]+,0\\)$"), "number": schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"),
        "array": schema.startswith("ARRAY"), "object": schema.startswith("OBJECT"),
    }[kind]


def exact_call(call: Column, presented: Column, shown: Column, order: str = "index_first") -> Column:
    """struct(arguments, reason): a zoom call held against the crop it made.

    `call` is the call's JSON text, either {region_description, img_idx} or
    {name, arguments} with label, img_idx and bbox_2d; `presented` the images of
    its result; `shown` all images of the conversation. The arguments are written
    anew from the crop: its box on the parent, in thousandths of the parent's
    shown size. Reasons, the first that applies: not_an_object, other_tool,
    unreadable_arguments, arguments_not_an_object, inexact_arguments,
    not_one_image, unknown_image, not_a_crop, other_parent, no_box,
    unknown_parent, no_parent_size, box_differs (a given box further than one
    from the crop's). `order` is index_first or label_first.
    """
    if order not in ("index_first", "label_first"):
        raise ValueError(f"unknown order of arguments: {order}")

    def with_arguments(v: Column) -> Column:
        written = _variant(v, "$.arguments", "string").cast("string")
        return bound(F.coalesce(F.try_parse_json(written), _variant(v, "$.arguments", "object")), lambda given: bound(asked(v, written, given), checked))

    def asked(v: Column, written: Column, given: Column) -> Column:
        """What either form of a call says, and whether it has that form."""
        parts = F.try_variant_get(_variant(given, "$.bbox_2d", "array"), "$", "array<variant>")
        numbers = F.transform(parts, lambda n: F.when(F.schema_of_variant(n).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(n, "$", "double")))
        is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
        return F.struct(
            is_object(v).alias("object"), _variant(v, "$.region_description", "string").cast("string").alias("plain_label"), _variant(v, "$.img_idx", "integer").cast("int").alias("plain_idx"),
            F.coalesce(_variant(v, "$.name", "string").cast("string") == ZOOM, F.lit(False)).alias("zoom"), (written.isNotNull() & given.isNull()).alias("unreadable"), is_object(given).alias("arguments"),
            _variant(given, "$.label", "string").cast("string").alias("label"), _variant(given, "$.img_idx", "integer").cast("int").alias("idx"), numbers.alias("numbers"),
        )

    def checked(a: Column) -> Column:
        plain = a["plain_label"].isNotNull() & a["plain_idx"].isNotNull()
        four = F.coalesce((F.size(a["numbers"]) == 4) & F.forall(a["numbers"], lambda n: n.isNotNull()), F.lit(False))
        wrong = (
            F.when(~a["object"], "not_an_object").when(plain, F.lit(None)).when(~a["zoom"], "other_tool").when(a["unreadable"], "unreadable_arguments")
            .when(~a["arguments"], "arguments_not_an_object").when(a["label"].isNull() | a["idx"].isNull() | ~four, "inexact_arguments")
        )
        return F.struct(
            F.when(plain, a["plain_label"]).otherwise(a["label"]).alias("label"), F.when(plain, a["plain_idx"]).otherwise(a["idx"]).alias("idx"),
            F.when(~plain, F.transform(a["numbers"], lambda n: F.bround(n))).alias("box"), wrong.alias("wrong"),
        )

    def against(a: Column) -> Column:
        find = lambda k: F.get(F.filter(shown, lambda s: s["presented_img_idx"] == k), F.lit(0))
        new = F.when(F.size(presented) == 1, F.get(presented, F.lit(0)))
        return bound(F.struct(a.alias("a"), new.alias("new"), find(new).alias("crop"), find(a["idx"]).alias("parent")), judged)

    def judged(x: Column) -> Column:
        a, crop, parent = x["a"], x["crop"], x["parent"]
        size = parent["display_size"]
        whole = F.transform(crop["bbox_on_presented"], lambda v: v.cast("int").cast("double"))
        made = to_thousandths(whole, F.get(size, F.lit(0)), F.get(size, F.lit(1)))
        right_size = F.coalesce((F.size(size) == 2) & (F.get(size, F.lit(0)) >= 1) & (F.get(size, F.lit(1)) >= 1), F.lit(False))
        reason = (
            F.when(a["wrong"].isNotNull(), a["wrong"]).when(x["new"].isNull(), "not_one_image").when(crop.isNull(), "unknown_image").when(~F.coalesce(crop["kind"] == "region_crop", F.lit(False)), "not_a_crop")
            .when(~crop["parent_presented_img_idx"].eqNullSafe(a["idx"]), "other_parent").when(~F.coalesce(F.size(crop["bbox_on_presented"]) == 4, F.lit(False)), "no_box").when(parent.isNull(), "unknown_parent")
            .when(~right_size, "no_parent_size").when(a["box"].isNotNull() & ~within_tolerance(a["box"], made.cast("array<double>")), "box_differs")
        )
        quoted = F.to_json(F.struct(a["label"].alias("l")))
        label = F.concat(F.lit('"label": '), F.substring(quoted, 6, 2**30 - 1).substr(F.lit(1), F.length(quoted) - 6))
        box = F.concat(F.lit('"bbox_2d": ['), F.array_join(made.cast("array<string>"), ", "), F.lit("]"))
        index = F.concat(F.lit('"img_idx": '), a["idx"].cast("string"))
        text = F.concat(F.lit("{"), F.concat_ws(", ", *((index, label, box) if order == "index_first" else (label, box, index))), F.lit("}"))
        return F.struct(F.when(reason.isNull(), text).alias("arguments"), reason.alias("reason"))

    return bound(bound(F.try_parse_json(call), with_arguments), against)


def exact_calls(messages: Column, shown: Column, order: str = "index_first") -> Column:
    """For each message (CALLING) that is an assistant's tool call its `exact_call` with the message after it; null for the others."""
    images = F.coalesce(shown, F.array().cast(SHOWN))
    after = lambda i: F.get(messages, i + 1)
    mine = lambda m: (m["role"] == "assistant") & (m["type"] == "tool_call")
    return F.transform(messages, lambda m, i: F.when(mine(m), exact_call(m["call"], after(i)["presented"], images, order)))


def assistant_text(think: Column, answer: Column | None, tagged: bool = True) -> Column:
    """An assistant's text: thought and answer in tags, or plain with a blank line between them; without an answer (a tool call) the thought alone."""
    think = F.coalesce(think, F.lit(""))
    if answer is None:
        return F.when(think == "", F.lit("")).otherwise(F.concat(F.lit("<think>"), think, F.lit("</think>")) if tagged else think)
    answer = F.coalesce(answer, F.lit(""))
    if tagged:
        return F.concat(F.lit("<think>"), think, F.lit("</think>\n<answer>"), answer, F.lit("</answer>"))
    return F.when((think != "") & (answer != ""), F.concat(think, F.lit("\n\n"), answer)).when(think != "", think).otherwise(answer)


def parts_text(parts: Column, keep_text: bool = True, last_round_hint: str | None = None) -> Column:
    """A message's parts (array of kind, text, label) as one text with <image> tags, each image after its label.

    Without `keep_text` (a successful tool result) only labels and images stay; a
    text equal to `last_round_hint` is left out. Other kinds of parts give null.
    """
    same = (lambda p: F.lit(False)) if last_round_hint is None else (lambda p: (p["kind"] == "text") & (clean_text(p["text"]) == last_round_hint.strip()))
    known = F.forall(parts, lambda p: p["kind"].isin("text", "separator", "image_ref"))
    label = lambda p: F.when(F.coalesce(p["label"], F.lit("")) != "", F.concat(p["label"], F.lit(":"))).otherwise(F.lit(""))
    text = lambda p: F.when(F.lit(not keep_text) | same(p), F.lit("")).otherwise(F.coalesce(p["text"], F.lit("")))
    pieces = F.transform(parts, lambda p: F.when(p["kind"] == "image_ref", F.concat(label(p), F.lit("<image>"))).otherwise(text(p)))
    return F.when(known, F.array_join(pieces, ""))


def labelled_parts(parts: Column, separator: str = "---") -> Column:
    """Parts of an old user message (array of type, text, detail) as kind, text, label, presented_img_idx, detail.

    A text `Image 3:` labels the next image and goes; the separator's text is a
    part of its own kind; an image without a label before it has none. Parts of
    other types are left out.
    """
    none = F.lit(None).cast("string")
    kind = "struct<kind:string,text:string,label:string,presented_img_idx:int,detail:string>"
    made = lambda k, text=none, label=none, idx=None, detail=none: F.struct(F.lit(k).alias("kind"), text.alias("text"), label.alias("label"), (F.lit(None) if idx is None else idx).cast("int").alias("presented_img_idx"), detail.alias("detail")).cast(kind)
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), none.alias("label"))

    def step(acc: Column, p: Column) -> Column:
        trimmed = clean_text(F.coalesce(p["text"], F.lit("")))
        idx = F.regexp_extract(trimmed, r"^Image (\d+):$", 1)
        add = lambda part, label: F.struct(F.concat(acc["out"], F.array(part)).alias("out"), label.alias("label"))
        held = acc["label"]
        return (
            F.when((p["type"] == "text") & (trimmed == separator), add(made("separator", F.lit(f"\n{separator}\n")), held))
            .when((p["type"] == "text") & (idx != ""), F.struct(acc["out"].alias("out"), F.regexp_replace(trimmed, ":$", "").alias("label")))
            .when(p["type"] == "text", add(made("text", p["text"]), held))
            .when(p["type"] == "image_url", add(made("image_ref", label=held, idx=F.regexp_extract(held, r"(\d+)$", 1), detail=p["detail"]), none))
            .otherwise(acc)
        )

    return F.aggregate(parts, start, step)["out"]


def recovered_result(parts: Column, last_round_hint: str) -> Column:
    """struct(hint, presented, secondary): what `labelled_parts` tell of a tool result; null if no image among them is labelled.

    hint is the text but for the hint of the last round, whose presence
    `secondary` tells; presented are the labelled images.
    """
    is_hint = lambda p: clean_text(p["text"]) == last_round_hint.strip()
    texts = F.filter(parts, lambda p: p["kind"] == "text")
    shown = F.transform(F.filter(parts, lambda p: p["presented_img_idx"].isNotNull()), lambda p: p["presented_img_idx"])
    hint = clean_text(F.array_join(F.transform(F.filter(texts, lambda p: ~is_hint(p)), lambda p: p["text"]), ""))
    secondary = F.when(F.exists(texts, is_hint), F.array(F.lit("last_round_hint"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(shown) > 0, F.struct(hint.alias("hint"), shown.alias("presented"), secondary.alias("secondary")))


def convert(messages: Column, stitch_hints: bool = True, calls: Column | None = None) -> Column:
    """A conversation's training row: struct of kept (role, text, loss, arguments) and drop_reason (null if it is kept).

    With `calls` (`exact_calls`), a call that isn't exact drops the conversation
    for its reason, and a kept one has its arguments.

    Rules at a message, the first that applies: a system message is kept
    without loss. An assistant's answer followed by the user's verification hint
    and a non-empty answer or revision is replaced by the latter. A tool call is
    kept if the user's tool result follows; a call without one, or with a failed
    one, drops the conversation. A non-empty answer or revision is kept, an empty
    one drops it. With `stitch_hints`, format repair and last round hints are
    left out, an assistant's other message before a repair hint together with
    it. Any other assistant message, and a failed tool result, drops it. Other
    user messages are kept without loss, tool results as role tool. An empty or
    null array is dropped as empty.
    """
    at = lambda i: F.get(messages, i)
    filled = lambda m: clean_text(F.coalesce(m["text"], F.lit(""))) != ""
    keep = lambda role, text, loss: F.array(F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), text.alias("text"), F.lit(loss).alias("loss"), F.lit(None).cast("string").alias("arguments")))
    nothing = F.array().cast("array<struct<role:string,text:string,loss:boolean,arguments:string>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("skip"), nothing.alias("kept"), F.lit(None).cast("string").alias("reason"))

    def step(acc: Column, m: Column) -> Column:
        i = acc["i"]
        one, two = at(i + 1), at(i + 2)
        role, kind = m["role"], F.coalesce(m["type"], F.lit(""))
        answer = kind.isin("answer", "answer_revision")
        revised = (kind == "answer") & (one["type"] == "answer_verification_hint") & (two["role"] == "assistant") & two["type"].isin("answer", "answer_revision") & filled(two)
        has_result = (one["role"] == "user") & (one["type"] == "tool_result")
        repaired = F.lit(stitch_hints) & (kind == "others") & (one["type"] == "format_repair_hint")
        hint = F.lit(stitch_hints) & kind.isin("format_repair_hint", "last_round_hint")
        same = lambda x: F.coalesce(x, F.lit(False))

        def outcome(kept: Column, skip: int = 0, reason: str | Column | None = None) -> Column:
            why = reason if isinstance(reason, Column) else F.lit(reason)
            return F.struct((i + 1).alias("i"), F.lit(skip).alias("skip"), F.concat(acc["kept"], kept).alias("kept"), why.cast("string").alias("reason"))

        own = F.get(calls, i) if calls is not None else None
        called = keep("assistant", m["text"], True) if own is None else F.transform(keep("assistant", m["text"], True), lambda k: k.withField("arguments", own["arguments"]))
        inexact = F.lit(None).cast("string") if own is None else F.when(own.isNull(), "not_an_object").otherwise(own["reason"])

        assistant = (
            F.when(same(revised), outcome(keep("assistant", two["text"], True), 2))
            .when((kind == "tool_call") & same(has_result) & inexact.isNotNull(), outcome(nothing, 0, inexact))
            .when((kind == "tool_call") & same(has_result), outcome(called))
            .when(kind == "tool_call", outcome(nothing, 0, "tool_call_without_result"))
            .when(answer & filled(m), outcome(keep("assistant", m["text"], True)))
            .when(answer, outcome(nothing, 0, "empty_answer"))
            .when(same(repaired), outcome(nothing, 1))
            .otherwise(outcome(nothing, 0, "unsupported_assistant_message"))
        )
        user = (
            F.when(hint, outcome(nothing))
            .when(kind == "tool_result_fail_hint", outcome(nothing, 0, "failed_tool_result"))
            .when(kind == "tool_result", outcome(keep("tool", m["text"], False)))
            .otherwise(outcome(keep("user", m["text"], False)))
        )
        done = F.struct((i + 1).alias("i"), F.greatest(acc["skip"] - 1, F.lit(0)).alias("skip"), acc["kept"].alias("kept"), acc["reason"].alias("reason"))
        return (
            F.when(acc["reason"].isNotNull() | (acc["skip"] > 0), done)
            .when(role == "system", outcome(keep("system", m["text"], False)))
            .when(role == "assistant", assistant)
            .when(role == "user", user)
            .otherwise(outcome(keep(F.coalesce(role, F.lit("unknown")), F.to_json(m), False)))
        )

    folded = F.aggregate(messages, start, step)
    empty = F.coalesce(F.size(messages) == 0, F.lit(True))
    return F.struct(F.when(empty, nothing).otherwise(folded["kept"]).alias("kept"), F.when(empty, F.lit("empty")).otherwise(folded["reason"]).alias("drop_reason"))


def training_rows(conversations: DataFrame, gates: dict[str, Column] | None = None, calls: Column | None = None) -> DataFrame:
    """Adds kept and drop_reason; the gates (reason to condition that drops) come first, in order, then conversion's own reason."""
    converted = conversations.withColumn("_c", convert(F.col("messages"), calls=calls))
    reason = F.col("_c.drop_reason")
    for name, condition in reversed(list((gates or {}).items())):
        reason = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    return converted.withColumn("drop_reason", reason).withColumn("kept", F.when(F.col("drop_reason").isNull(), F.col("_c.kept"))).drop("_c")


def drop_reasons(rows: DataFrame) -> DataFrame:
    """Dropped rows per reason, most frequent first."""
    return rows.where("drop_reason is not null").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "drop_reason")


def prompt_text(question: Column, n_images: Column) -> Column:
    """A prompt with a numbered label for every image, then the question."""
    labels = F.transform(F.when(n_images > 0, F.sequence(F.lit(1), n_images)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit("Image "), k.cast("string"), F.lit(": <image>")))
    return F.array_join(F.concat(labels, F.array(question)), "\n---\n")
