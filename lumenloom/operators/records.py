"""Requests to and records of chat models, and the image references that records carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.text import rewrite_prefix
from lumenloom.functions.values import bound

MESSAGES = "array<struct<role:string,content:string>>"
PART = "struct<type:string,text:string,url:string,detail:string>"
#: A reference to an image, as records write it.
REF = "struct<source_type:string,path:string,value:string,url:string,uri:string>"


def _part(kind: str, text: Column | None = None, url: Column | None = None, detail: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), (none if text is None else text).alias("text"), (none if url is None else url).alias("url"), F.lit(detail).cast("string").alias("detail"))


def chat_messages(prompt: Column, urls: Column, detail: str | None = None) -> Column:
    """A prompt (MESSAGES) as chat messages: array of role (user if it has none) and parts of text and images in order.

    Every <image> tag takes the next of `urls`, over all messages; a tag without
    one left goes, empty texts too. Images left over come before the last
    message's parts, or make up a user message if there is none.
    """
    given = F.coalesce(prompt, F.array().cast(MESSAGES))
    images = F.coalesce(urls, F.array().cast("array<string>"))
    image = lambda u: _part("image_url", url=u, detail=detail)

    def built(x: Column) -> Column:
        messages, all_urls = x["m"], x["u"]
        pieces = F.transform(messages, lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), F.split(F.coalesce(m["content"], F.lit("")), "<image>", -1).alias("p")))
        tags = lambda m: F.size(m["p"]) - 1
        before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda acc, m: acc + tags(m))

        def parts(m: Column, start: Column) -> Column:
            each = F.transform(m["p"], lambda t, k: F.array(F.when(k > 0, bound(F.get(all_urls, start + k - 1), lambda u: F.when(u.isNotNull(), image(u)))), F.when(t != "", _part("text", t))))
            return F.filter(F.flatten(each), lambda p: p.isNotNull())

        out = F.transform(pieces, lambda m, i: F.struct(m["role"].alias("role"), bound(before(i), lambda start: parts(m, start)).alias("parts")))
        used = F.aggregate(pieces, F.lit(0), lambda acc, m: acc + tags(m))
        rest = F.transform(F.slice(all_urls, used + 1, F.greatest(F.size(all_urls), F.lit(1))), image)
        n = F.size(out)
        last = F.transform(out, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == n - 1, F.concat(rest, m["parts"])).otherwise(m["parts"]).alias("parts")))
        alone = F.array(F.struct(F.lit("user").alias("role"), rest.alias("parts")))
        return F.when(F.size(messages) > 0, last).when(F.size(rest) > 0, alone).otherwise(last)

    return bound(F.struct(given.alias("m"), images.alias("u")), built)


def pruned_content(parts: Column) -> Column:
    """A message's parts (PART) without what isn't text: array of type and text, [pruned] in place of other content."""
    return F.transform(parts, lambda p: F.struct(F.coalesce(p["type"], F.lit("unknown")).alias("type"), F.when(p["type"] == "text", p["text"]).otherwise("[pruned]").alias("text")))


def tool_call_text(name: Column, arguments: Column) -> Column:
    """A structured tool call as the tagged text models write; arguments that aren't JSON become a JSON text."""
    quoted = lambda c: bound(F.to_json(F.struct(c.alias("v"))), lambda t: t.substr(F.lit(6), F.length(t) - 6))
    body = F.when(F.try_parse_json(arguments).isNotNull(), arguments).when(arguments.isNull(), F.lit("{}")).otherwise(quoted(arguments))
    return F.concat(F.lit('<tool_call>\n{"name": '), quoted(name), F.lit(', "arguments": '), body, F.lit("}\n</tool_call>"))


def usage_number(usage: Column, name: str) -> Column:
    """A whole number of a response's usage, given as JSON text; null if it is absent or isn't a number."""
    return F.get_json_object(usage, f"$.{name}").try_cast("double").cast("bigint")


def sample_records(responses: DataFrame, agent: str) -> DataFrame:
    """Samples of a rollout from a model's responses.

    Takes sample_index, trial_idx, uid, data_source, ground_truth, question_id,
    prompt_messages (their number), text, finish_reason, usage (JSON text),
    failure_reasons, wall_time_s and path, the place of the exported
    conversation. Any reason is a critical failure; the uid falls back to the
    question's id, then to the index.
    """
    reasons = F.coalesce("failure_reasons", F.array().cast("array<string>"))
    text = F.coalesce("text", F.lit(""))
    tokens = usage_number(F.col("usage"), "completion_tokens")
    return responses.select(
        "sample_index", "trial_idx", F.coalesce(F.when(F.col("uid") != "", F.col("uid")), F.when(F.col("question_id") != "", F.col("question_id")), F.col("sample_index").cast("string")).alias("uid"),
        "data_source", "ground_truth", text.alias("solution_str"), F.struct(F.lit(agent).alias("agent_name"), "question_id", F.col("path").alias("conversation_export_json_path")).alias("extra_info"),
        F.coalesce(F.col("finish_reason") == "length", F.lit(False)).alias("response_truncated"), (F.size(reasons) > 0).alias("critical_failure"), reasons.alias("failure_reasons"),
        (F.col("prompt_messages") + F.when(text != "", 1).otherwise(0)).alias("num_turns"), F.lit(0).alias("n_tool_calls"), "wall_time_s", F.col("wall_time_s").alias("conversation_wall_time"),
        usage_number(F.col("usage"), "prompt_tokens").alias("prompt_tokens"), tokens.alias("response_tokens_total"), tokens.alias("response_tokens_generated"), F.lit(0).cast("bigint").alias("response_tokens_tool"),
    )


def ref_value(ref: Column) -> Column:
    """What a reference (REF) points to, by its source type: a path, a value or url, a url or value; the first there is for other types."""
    filled = lambda c: F.when(c != "", c)
    value, url, path = filled(ref["value"]), filled(ref["url"]), filled(ref["path"])
    kind = ref["source_type"]
    return F.when(kind == "path", ref["path"]).when(kind.isin("path_or_url", "image_url"), F.coalesce(value, url)).when(kind.isin("url", "data_url"), F.coalesce(url, value)).otherwise(F.coalesce(value, path, url))


def local_path(ref: Column) -> Column:
    """The local path a reference points to, file:// taken off; null for web addresses, data and nothing."""
    def plain(v: Column) -> Column:
        return F.when((v == "") | v.startswith("data:") | F.lower(v).rlike("^https?://"), F.lit(None)).otherwise(F.regexp_replace(v, "^file://", ""))

    return bound(ref_value(ref), plain)


def rewritten_refs(refs: Column, mappings: dict[str, str]) -> Column:
    """struct(refs, changed): references whose value, uri and path have their mapped prefix replaced, and whether any was."""
    moved = F.transform(refs, lambda r: F.struct(r["source_type"].alias("source_type"), rewrite_prefix(r["path"], mappings).alias("path"), rewrite_prefix(r["value"], mappings).alias("value"), r["url"].alias("url"), rewrite_prefix(r["uri"], mappings).alias("uri")))
    return bound(moved, lambda new: F.struct(new.alias("refs"), F.coalesce(~new.eqNullSafe(refs), F.lit(False)).alias("changed")))


def packed_name(path: Column, content: Column) -> Column:
    """Name of an image in a bundle: 16 digits of its content's SHA-1, its cleaned stem (96 signs at most), its ending."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ending = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    stem = F.substring(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), r"[^\p{L}\p{N}._-]", "-"), 1, 96)
    return F.concat(F.substring(F.sha1(content), 1, 16), F.lit("_"), F.when(stem == "", "image").otherwise(stem), F.when(ending == "", ".img").otherwise(ending))


def pack_references(records: DataFrame, images: DataFrame, key: str = "json_name", refs: str = "input_images") -> tuple[DataFrame, DataFrame]:
    """Records with references into a bundle, and the report of those that aren't in it.

    `images` has path and content (as `binaryFile` reads them, file: taken off);
    equal contents get one name only if their files are named alike. Result: (key,
    idx, source_type, value, packed), one row per reference, packed null where
    the reference stays as it was; and (key, idx, value, problem), problem being
    missing (a local file that isn't among the images) or nonlocal. Data URLs
    stay and are no problem. References meet images by an equi-join on the path.
    """
    each = records.select(key, F.posexplode(refs).alias("idx", "ref")).where("ref is not null")
    known = images.select(F.regexp_replace("path", "^file:(//)?", "").alias("_path"), F.concat(F.lit("images/"), packed_name(F.col("path"), F.col("content"))).alias("packed"))
    placed = each.select(key, "idx", "ref.source_type", ref_value(F.col("ref")).alias("value"), local_path(F.col("ref")).alias("_local")).join(known, F.col("_local") == F.col("_path"), "left")
    data = F.coalesce(F.col("value").startswith("data:") | (F.col("source_type") == "data_url"), F.lit(False))
    problem = F.when(~data & F.col("packed").isNull(), F.when(F.col("_local").isNotNull(), "missing").otherwise("nonlocal"))
    return placed.select(key, "idx", "source_type", "value", "packed"), placed.select(key, "idx", "value", problem.alias("problem")).where("problem is not null")
