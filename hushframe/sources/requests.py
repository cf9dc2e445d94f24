"""Request logs: JSON bodies of three wire formats to typed segments, inside the row.

``request_log`` columns: request_id, ts, wire_format, source_header, body,
response (JSON text). A body carries its own history, so every step here is a
projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import find_spans
from hushframe.functions.text import any_of, let, once, starts_with_any, strip
from hushframe.operators.redact import JSON_STRING, json_unescape
from hushframe.operators.row_vault import restore_row

SEGMENT = "struct<author:string,novel:boolean,text:string>"

# Marks of text a tool put into a user turn.
TRANSCRIPT_PREFIXES = ("User:", "Assistant:", "Human:", "System:")
BRACKET_DIRECTIVES = ("[SUGGESTION MODE:",)
HARNESS_TAGS = (
    "system-reminder", "command-name", "command-message", "command-args", "local-command-stdout",
    "local-command-stderr", "ide_selection", "session", "transcript", "user_instructions", "environment_context",
)
WRAPPED_BLOCK = r"(?s)^<([A-Za-z][\w-]*)\b[^>]*>.*</\1\s*>$"
LEADING_TAG = r"^<([A-Za-z][\w-]*)\b[^>]*>"

# Blocks signed by the model; never read, never changed.
SIGNED_BLOCKS = ("thinking", "redacted_thinking")

# What marks a background call.
SAFETY_MARKERS = (
    "stage 1 does not apply user intent", "err on the side of blocking", "you are a command",
    "command injection", "<policy_spec>",
)
HELPER_MARKERS = (
    "<session>", "<transcript>", "isnewtopic", "new conversation topic", "word title", "concise title",
    "summarize the conversation", "summary of the conversation",
)
CONTEXT_TAGS = (
    "system-reminder", "ide_selection", "command-name", "command-message", "command-args",
    "local-command-stdout", "local-command-stderr", "user_instructions", "environment_context",
)

# The tool behind a wire format when a request does not say.
DEFAULT_SOURCE = {"anthropic": "claude-code", "openai_chat": "openai-chat", "openai_responses": "codex"}

# Editor hook events and the field with their text.
HOOK_FIELDS = {"beforeSubmitPrompt": "prompt", "beforeReadFile": "content", "afterAgentResponse": "text"}


# --- JSON access ------------------------------------------------------------


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """A member only if it is a JSON string."""
    return F.when(_is(_at(v, path), "STRING"), _at(v, path, "string"))


def _list(v: Column, path: str = "$") -> Column:
    return F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _segment(author: Column | str, novel: Column | bool, text: Column) -> Column:
    author = F.lit(author) if isinstance(author, str) else author
    novel = F.lit(novel) if isinstance(novel, bool) else novel
    return F.struct(author.alias("author"), novel.alias("novel"), text.alias("text")).cast(SEGMENT)


def _one(seg: Column) -> Column:
    """[segment], or nothing if its text is null."""
    return F.filter(F.array(seg), lambda g: g["text"].isNotNull())


def _none() -> Column:
    return F.array().cast(f"array<{SEGMENT}>")


def _all_strings(v: Column, make: Callable[[Column], Column]) -> Column:
    """Every string value inside a JSON value (object members in key order)."""

    def cut(body: Column) -> Column:
        tokens = find_spans(body, JSON_STRING, "", accept=lambda t: ~t.endswith(":"))
        return F.transform(tokens, lambda s: make(json_unescape(F.substring(body, s["start"] + 2, s["end"] - s["start"] - 2))))

    return F.when(v.isNull(), _none()).otherwise(let(F.to_json(v), cut))


# A string member named text or content, at any depth of a JSON text.
NESTED_TEXT = r'(?<pre>"(?:text|content)"\s*:\s*)(?<hit>"[^"\\]*+(?:\\.[^"\\]*+)*+")'


def _nested_texts(v: Column, make: Callable[[Column], Column]) -> Column:
    """Segments of all texts in a tool result, however deep its blocks are nested."""

    def cut(body: Column) -> Column:
        tokens = find_spans(body, NESTED_TEXT, "")
        return F.transform(tokens, lambda s: make(json_unescape(F.substring(body, s["start"] + 2, s["end"] - s["start"] - 2))))

    inner = F.when(v.isNull(), _none()).otherwise(let(F.to_json(v), cut))
    return F.when(_is(v, "STRING"), _one(make(_text(v, "$")))).otherwise(inner)


def parsed(requests: DataFrame, body: str = "body", name: str = "json") -> DataFrame:
    """Adds the body as a variant and keeps JSON objects only."""
    return requests.withColumn(name, once(F.try_parse_json(F.col(body)))).filter(_is(F.col(name), "OBJECT"))


# --- authorship -------------------------------------------------------------


def is_injected(text: Column) -> Column:
    """Text a tool put into a user turn: role labels, a directive, a wrapped block, a harness tag."""

    def rules(s: Column) -> Column:
        tag = F.lower(F.regexp_extract(s, LEADING_TAG, 1))
        return (
            starts_with_any(s, TRANSCRIPT_PREFIXES)
            | starts_with_any(s, BRACKET_DIRECTIVES)
            | (s.startswith("<") & (s.rlike(WRAPPED_BLOCK) | tag.isin(*HARNESS_TAGS)))
        )

    return F.coalesce(let(strip(text), rules), F.lit(False))


def _user(novel: Column | bool) -> Callable[[Column], Column]:
    return lambda t: _segment(F.when(is_injected(t), "machine").otherwise("user"), novel, t)


def _tool(novel: Column | bool) -> Callable[[Column], Column]:
    return lambda t: _segment("tool", novel, t)


def _machine(t: Column) -> Column:
    return _segment("machine", False, t)


def last_assistant(items: Column, with_calls: bool = False) -> Column:
    """Position of the last assistant message (or function call), -1 if none; what comes after is new."""

    def position(m: Column, i: Column) -> Column:
        mine = F.coalesce(_text(m, "$.role") == "assistant", F.lit(False))
        if with_calls:
            mine = mine | F.coalesce(_text(m, "$.type") == "function_call", F.lit(False))
        return F.when(mine, i).otherwise(-1)

    return F.coalesce(F.array_max(F.transform(items, position)), F.lit(-1))


def _blocks(content: Column, make: Callable[[Column], Column]) -> Column:
    """Segments of a content value: a string, or the ``text`` of each block."""
    each = F.transform(_list(content), lambda b: _text(b, "$.text"))
    return F.when(_is(content, "STRING"), _one(make(_text(content, "$")))).otherwise(
        F.transform(F.filter(each, lambda t: t.isNotNull()), make)
    )


def _by_role(role: Column, novel: Column) -> Callable[[Column], Column]:
    """Text of a message: the user's (unless injected), a tool's, or the machine's."""

    def make(t: Column) -> Column:
        mine = role.isin("user", "tool")
        author = F.when((role == "user") & ~is_injected(t), "user").when(role == "tool", "tool").otherwise("machine")
        return _segment(author, mine & novel, t)

    return make


def _role(m: Column) -> Column:
    return F.coalesce(_text(m, "$.role"), F.lit(""))


def _anthropic_content(content: Column, text_fn, data_fn) -> Column:
    """Text, tool results and tool inputs of a content value; signed blocks are skipped."""

    def block(b: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            own = _one(text_fn(_text(b, "$.text")))
            extra = (
                F.when(kind == "tool_result", _nested_texts(_at(b, "$.content"), data_fn))
                .when(kind == "tool_use", _all_strings(_at(b, "$.input"), _machine))
                .otherwise(_none())
            )
            return F.when(kind.isin(*SIGNED_BLOCKS), _none()).otherwise(F.concat(own, extra))

        return let(F.coalesce(_text(b, "$.type"), F.lit("")), by_kind)

    return F.when(_is(content, "STRING"), _one(text_fn(_text(content, "$")))).otherwise(
        F.flatten(F.transform(_list(content), block))
    )


def _each_message(items: Column, with_calls: bool, message: Callable[[Column, Column, Column], Column]) -> Column:
    """Segments of all messages; ``message`` gets it, its role, and whether it is new."""

    def over(ms: Column) -> Column:
        return let(
            last_assistant(ms, with_calls),
            lambda last: F.flatten(F.transform(ms, lambda m, i: let(_role(m), lambda role: message(m, role, i > last)))),
        )

    return let(items, over)


def _anthropic_segments(body: Column) -> Column:
    def message(m: Column, role: Column, new: Column) -> Column:
        # this format has no tool role: only "user" is special here
        speaker = F.when(role == "user", "user").otherwise("")
        return _anthropic_content(_at(m, "$.content"), _by_role(speaker, new), _tool(new))

    return F.concat(_blocks(_at(body, "$.system"), _machine), _each_message(_list(body, "$.messages"), False, message))


def _chat_segments(body: Column) -> Column:
    def message(m: Column, role: Column, new: Column) -> Column:
        calls = F.transform(_list(m, "$.tool_calls"), lambda c: _text(c, "$.function.arguments"))
        return F.concat(
            _blocks(_at(m, "$.content"), _by_role(role, new)), F.transform(F.filter(calls, lambda t: t.isNotNull()), _machine)
        )

    return _each_message(_list(body, "$.messages"), False, message)


def _responses_segments(body: Column) -> Column:
    given = _at(body, "$.input")

    def message(m: Column, role: Column, new: Column) -> Column:
        kind = F.coalesce(_text(m, "$.type"), F.lit(""))
        speaker = F.when(role == "user", "user").otherwise("")
        extra = (
            F.when(kind == "function_call_output", _one(_tool(new)(_text(m, "$.output"))))
            .when(kind == "function_call", _one(_machine(_text(m, "$.arguments"))))
            .otherwise(_none())
        )
        return F.concat(_blocks(_at(m, "$.content"), _by_role(speaker, new)), extra)

    return F.concat(
        _one(_machine(_text(body, "$.instructions"))),
        F.when(_is(given, "STRING"), _one(_user(True)(_text(body, "$.input")))).otherwise(
            _each_message(_list(given), True, message)
        ),
    )


def segments_of(wire: Column, body: Column) -> Column:
    """array<struct<author,novel,text>> of a request body, in reading order."""
    return (
        F.when(wire == "anthropic", _anthropic_segments(body))
        .when(wire == "openai_chat", _chat_segments(body))
        .when(wire == "openai_responses", _responses_segments(body))
        .otherwise(_none())
    )


def segments(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per segment: key, pos, author, novel, text."""
    rows = parsed(requests).select(key, F.posexplode_outer(segments_of(F.col("wire_format"), F.col("json"))).alias("pos", "g"))
    return rows.filter("g is not null").select(key, "pos", "g.author", "g.novel", "g.text")


# --- request level facts ----------------------------------------------------


def _contents(content: Column) -> Column:
    """The texts of a content value as array<string>."""
    return F.when(_is(content, "STRING"), F.array(_text(content, "$"))).otherwise(
        F.filter(F.transform(_list(content), lambda b: _text(b, "$.text")), lambda t: t.isNotNull())
    )


def _with_role(items: Column, role: str) -> Column:
    return F.filter(items, lambda m: F.coalesce(_text(m, "$.role") == role, F.lit(False)))


def _newest_user(items: Column) -> Column:
    users = _with_role(items, "user")
    return let(
        users,
        lambda us: F.when(F.size(us) == 0, F.array().cast("array<string>")).otherwise(
            _contents(_at(F.element_at(us, -1), "$.content"))
        ),
    )


def kind_of(wire: Column, body: Column) -> Column:
    """``safety``, ``helper`` or ``main`` by markers in the system text and the newest user turn."""
    chat_system = F.flatten(
        F.transform(_with_role(_list(body, "$.messages"), "system"), lambda m: _contents(_at(m, "$.content")))
    )
    given = _at(body, "$.input")
    instructions = F.filter(F.array(_text(body, "$.instructions")), lambda t: t.isNotNull())
    parts = (
        F.when(wire == "anthropic", F.concat(_contents(_at(body, "$.system")), _newest_user(_list(body, "$.messages"))))
        .when(wire == "openai_chat", F.concat(chat_system, _newest_user(_list(body, "$.messages"))))
        .when(
            wire == "openai_responses",
            F.concat(
                instructions,
                F.when(_is(given, "STRING"), F.array(_text(body, "$.input"))).otherwise(_newest_user(_list(given))),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
    )

    def votes(t: Column) -> Column:
        tag = F.lower(F.regexp_extract(t, r"(?U)^\s*<([A-Za-z][\w-]*)\b", 1))
        return (F.length(t) > 0) & ~tag.isin(*CONTEXT_TAGS)

    def mark(text: Column) -> Column:
        return (
            F.when(any_of(*[text.contains(m) for m in SAFETY_MARKERS]), "safety")
            .when(any_of(*[text.contains(m) for m in HELPER_MARKERS]), "helper")
            .otherwise("main")
        )

    return let(F.lower(F.array_join(F.filter(parts, votes), " ")), mark)


def conversation_key(wire: Column, body: Column) -> Column:
    """Explicit id where the format has one, else 16 hex of SHA-256 of the first user text, else null."""

    def given(path: str) -> Column:
        return F.nullif(_text(body, path), F.lit(""))

    def first_user(items: Column) -> Column:
        texts = F.transform(_with_role(items, "user"), lambda m: F.get(_contents(_at(m, "$.content")), F.lit(0)))
        return F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))

    inp = _at(body, "$.input")
    opening = F.when(wire.isin("anthropic", "openai_chat"), first_user(_list(body, "$.messages"))).when(
        wire == "openai_responses", F.when(_is(inp, "STRING"), _text(body, "$.input")).otherwise(first_user(_list(inp)))
    )
    hashed = F.when(F.length(opening) > 0, F.left(F.sha2(opening, 256), F.lit(16)))
    explicit = F.when(
        wire == "openai_responses",
        F.coalesce(given("$.prompt_cache_key"), given("$.client_metadata.thread_id"), given("$.client_metadata.session_id")),
    )
    return F.when(wire == "cursor", F.nullif(_at(body, "$.conversation_id", "string"), F.lit(""))).otherwise(
        F.coalesce(explicit, hashed)
    )


def usage_of(wire: Column, response: Column) -> Column:
    """struct<input_tokens, output_tokens> of a response."""
    chat = wire == "openai_chat"
    return F.struct(
        F.when(chat, _at(response, "$.usage.prompt_tokens", "bigint"))
        .otherwise(_at(response, "$.usage.input_tokens", "bigint"))
        .alias("input_tokens"),
        F.when(chat, _at(response, "$.usage.completion_tokens", "bigint"))
        .otherwise(_at(response, "$.usage.output_tokens", "bigint"))
        .alias("output_tokens"),
    )


def response_texts(wire: Column, response: Column) -> Column:
    """The human-readable texts of a response, in order."""

    def block(b: Column) -> Column:
        return F.when(~F.coalesce(_text(b, "$.type"), F.lit("")).isin(*SIGNED_BLOCKS), _text(b, "$.text"))

    answers = F.transform(_list(response, "$.choices"), lambda c: _text(c, "$.message.content"))
    items = F.concat(
        F.flatten(F.transform(_list(response, "$.output"), lambda o: _contents(_at(o, "$.content")))),
        F.array(_text(response, "$.output_text")),
    )
    texts = (
        F.when(wire == "anthropic", F.transform(_list(response, "$.content"), block))
        .when(wire == "openai_chat", answers)
        .when(wire == "openai_responses", items)
        .otherwise(F.array().cast("array<string>"))
    )
    return F.filter(texts, lambda t: t.isNotNull())


def rehydrate(wire: Column, response: Column, mapping: Column) -> Column:
    """array<struct<anonymized, original>> of a response's texts with the request's own map."""
    return restore_texts(response_texts(wire, response), mapping)


def restore_texts(texts: Column, mapping: Column) -> Column:
    return let(
        mapping,
        lambda m: F.transform(texts, lambda t: F.struct(t.alias("anonymized"), restore_row(t, m).alias("original"))),
    )


def source_of(wire: Column, *declared: Column) -> Column:
    """The declared tool (first non-empty header), else the wire format's default."""
    default = F.element_at(
        F.create_map(*[F.lit(x) for kv in DEFAULT_SOURCE.items() for x in kv]), wire
    )
    return F.coalesce(*[F.nullif(d, F.lit("")) for d in declared], default)


def with_facts(requests: DataFrame) -> DataFrame:
    """Request rows plus kind, conversation_id, model, source, tokens and segments."""
    df = parsed(requests)
    wire, body = F.col("wire_format"), F.col("json")
    df = df.withColumn("reply_json", F.try_parse_json(F.col("response")))
    reply = F.col("reply_json")
    header = F.col("source_header") if "source_header" in df.columns else F.lit(None).cast("string")
    return df.select(
        *requests.columns,
        kind_of(wire, body).alias("kind"),
        conversation_key(wire, body).alias("conversation_id"),
        F.coalesce(_at(body, "$.model", "string"), F.lit("unknown")).alias("model"),
        source_of(wire, header).alias("source"),
        usage_of(wire, reply).alias("usage"),
        once(segments_of(wire, body)).alias("segments"),
        once(response_texts(wire, reply)).alias("reply"),
    )


def hook_events(events: DataFrame, body: str = "body") -> DataFrame:
    """Editor hook events with text: event, conversation_id, model, category, text."""
    df = parsed(events, body)
    name = F.coalesce(_at(F.col("json"), "$.hook_event_name", "string"), F.lit(""))
    text = F.coalesce(*[F.when(name == k, _text(F.col("json"), f"$.{f}")) for k, f in HOOK_FIELDS.items()])
    category = F.when(name == "afterAgentResponse", "assistant").when(name == "beforeReadFile", "tool").otherwise("user")
    return df.select(
        *events.columns,
        name.alias("event"),
        conversation_key(F.lit("cursor"), F.col("json")).alias("conversation_id"),
        F.coalesce(_at(F.col("json"), "$.model", "string"), F.lit("unknown")).alias("model"),
        category.alias("category"),
        text.alias("text"),
    ).filter(F.length("text") > 0)

