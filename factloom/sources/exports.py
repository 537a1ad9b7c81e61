"""Readers of chat exports, agent sessions, JSON, text files and layers.

Files are listed by Spark's ``binaryFile`` source (or ``text`` for lines), so
that a folder of many files is read by many tasks; one file is one record.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections import deque
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "conversation_id string, title string, created_at double, updated_at double, message_id string, parent_id string, role string, content_text string, content_type string, sent_at double, sequence_order long"
_COLUMNS = [c.split()[0] for c in MESSAGES.split(", ")]
TEXT_SUFFIXES = (".txt", ".md", ".rst", ".docx")
TEXT_FIELDS = ("text", "content", "body", "message", "description", "note")
LEAST_CHARS, MOST_DEPTH = 50, 20


def seconds(value) -> float | None:
    """Epoch seconds of a number (milliseconds above 1e12), numeric text or ISO text; else null."""
    if value is None or value == "":
        return None
    try:
        n = float(value)
    except (TypeError, ValueError):
        stamp = pd.to_datetime(value, utc=True, errors="coerce") if isinstance(value, str) else pd.NaT
        return None if pd.isna(stamp) else stamp.timestamp()
    return n / 1000 if n > 1e12 else n


def content_text(content: dict | None) -> tuple[str, str]:
    """(text, type) of a message's content by its kind."""
    content = content or {}
    kind = content.get("content_type", "text")
    if kind == "code":
        return str(content.get("text") or ""), kind
    out = []
    for part in content.get("parts") or []:
        if isinstance(part, str):
            out.append(part)
        elif kind == "multimodal_text" and isinstance(part, dict):
            spoken = part.get("audio_transcription") or {}
            out.append(spoken.get("text") or part.get("text") or "[media]")
    return "\n".join(out), kind


def walk_tree(mapping: dict) -> Iterator[tuple[int, str, str | None, dict]]:
    """(sequence, id, parent, message) breadth first from the first node without a known parent.

    Nodes without a message take no number; a node is visited once.
    """
    root = next((i for i, n in mapping.items() if not n.get("parent") or n["parent"] not in mapping), None)
    queue, seen, number = deque([(root, None)] if root else []), set(), 0
    while queue:
        i, parent = queue.popleft()
        if i in seen or i not in mapping:
            continue
        seen.add(i)
        node = mapping[i]
        if node.get("message"):
            yield number, i, parent, node["message"]
            number += 1
        queue.extend((c, i) for c in node.get("children") or [])


def _tree_rows(conversation: dict) -> list[tuple]:
    created = seconds(conversation.get("create_time"))
    cid = conversation.get("conversation_id") or conversation.get("id") or f"{conversation.get('title')}_{conversation.get('create_time')}"
    rows = []
    for n, i, parent, message in walk_tree(conversation.get("mapping") or {}):
        text, kind = content_text(message.get("content"))
        hidden = (message.get("metadata") or {}).get("is_visually_hidden_from_conversation")
        if text.strip() and not hidden:
            role = (message.get("author") or {}).get("role")
            rows.append((cid, conversation.get("title"), created, seconds(conversation.get("update_time")), i, parent, role, text, kind, seconds(message.get("create_time")), n))
    return rows


def _flat_rows(conversation: dict) -> list[tuple]:
    cid = next((conversation[k] for k in ("uuid", "id", "conversation_id") if conversation.get(k)), None)
    rows = []
    for n, m in enumerate(conversation.get("chat_messages") or conversation.get("messages") or []):
        role = m.get("sender") or m.get("role")
        content = m.get("content") if isinstance(m.get("content"), list) else None
        text = m.get("text") or (m["content"] if isinstance(m.get("content"), str) else "\n".join(p.get("text", "") for p in content or [] if isinstance(p, dict) and p.get("type", "text") == "text"))
        if text and text.strip():
            rows.append((cid, conversation.get("name") or conversation.get("title"), seconds(conversation.get("created_at")), seconds(conversation.get("updated_at")), m.get("uuid") or m.get("id") or f"{cid}_{n}", None, "user" if role == "human" else role, text, "text", seconds(m.get("created_at")), n))
    return rows


def _documents(path: str, raw: bytes, member: re.Pattern) -> Iterator[object]:
    """The JSON values of a file, or of a ZIP's members; paths that climb out are passed over."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in sorted(z.namelist()):
                parts = PurePosixPath(name)
                if member.search(name) and not parts.is_absolute() and ".." not in parts.parts:
                    yield json.loads(z.read(name))
    else:
        yield json.loads(raw)


def _read(spark: SparkSession, path: str, glob: str, rows_of, member: str) -> DataFrame:
    pattern = re.compile(member)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"]):
                rows = []
                for value in _documents(name, bytes(raw), pattern):
                    for conversation in value if isinstance(value, list) else [value]:
                        if isinstance(conversation, dict):
                            rows += rows_of(conversation)
                if rows:
                    yield pd.DataFrame(rows, columns=_COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, MESSAGES)


def chat_tree_export(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Messages of an export of message trees (JSON or ZIP); known conversations are left out."""
    return _unknown(_read(spark, path, "*.{json,zip}", _tree_rows, r"conversations\.json$"), known)


def chat_list_export(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Messages of an export of message lists (ZIP, or a folder of JSON)."""
    return _unknown(_read(spark, path, "*.{json,zip}", _flat_rows, r"\.json$"), known)


def _unknown(messages: DataFrame, known: DataFrame | None) -> DataFrame:
    return messages if known is None else messages.join(known.select("conversation_id"), "conversation_id", "left_anti")


def _session_text(content: Column) -> Column:
    """Text of a session line: a string, or a list of text, tool and result parts."""
    parts = F.from_json(content, "array<struct<type:string,text:string,name:string>>")
    shown = F.transform(parts, lambda p: F.when(p["type"] == "tool_use", F.concat(F.lit("[tool: "), p["name"], F.lit("]"))).when(p["type"] == "tool_result", "[tool result]").otherwise(p["text"]))
    return F.when(F.ltrim(content).startswith("["), F.array_join(F.filter(shown, lambda s: s.isNotNull()), "\n")).otherwise(content)


def agent_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of agent sessions in JSON lines, one session a file; bad lines and other kinds are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    raw = lines.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.try_parse_json("value").alias("v"), "value").where("v IS NOT NULL")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    content = F.coalesce(F.get_json_object("value", "$.message.content"), F.lit(""))
    stamp = F.get_json_object("value", "$.timestamp")
    number = stamp.try_cast("double")
    sent = F.coalesce(F.when(number > 1e12, number / 1000).otherwise(number), F.unix_timestamp(F.try_to_timestamp(stamp)).cast("double"))
    m = raw.select(F.regexp_replace("file", r"\.jsonl$", "").alias("conversation_id"), "at", get("$.type").alias("role"), get("$.uuid").alias("message_id"), F.trim(_session_text(content)).alias("content_text"), sent.alias("sent_at"))
    return m.where(F.col("role").isin("user", "assistant") & (F.col("content_text") != ""))


def session_heads(messages: DataFrame) -> DataFrame:
    """(conversation_id, title, created_at, updated_at, message_count): the title is the first short user text, cut at 80."""
    short = F.when((F.col("role") == "user") & (F.char_length("content_text") <= 100), F.col("content_text"))
    first = F.min_by(short, F.when(short.isNotNull(), F.col("at")))
    title = F.when(F.char_length(first) > 80, F.concat(F.substring(first, 1, 79), F.lit("…"))).otherwise(first)
    return messages.groupBy("conversation_id").agg(title.alias("title"), F.min("sent_at").alias("created_at"), F.max("sent_at").alias("updated_at"), F.count("*").alias("message_count"))


def texts_in(value: object) -> list[str]:
    """Texts of at least 50 characters in a JSON value: those of known fields, else all; each once."""

    def walk(v: object, known: bool, depth: int) -> Iterator[str]:
        if depth > MOST_DEPTH:
            return
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, str):
                    if not known or k.lower() in TEXT_FIELDS:
                        yield x
                else:
                    yield from walk(x, known, depth + 1)
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, str):
                    if not known:
                        yield x
                else:
                    yield from walk(x, known, depth + 1)
        elif isinstance(v, str) and not known:
            yield v

    for known in (True, False):
        found = [t.strip() for t in walk(value, known, 0) if len(t.strip()) >= LEAST_CHARS]
        if found:
            return list(dict.fromkeys(found))
    return []


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, text) of any JSON files."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, raw in zip(f["path"], f["content"]):
                try:
                    value = json.loads(bytes(raw))
                except ValueError:
                    continue
                rows += [(name, k, t) for k, t in enumerate(texts_in(value))]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "position", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, position int, text string")


def _decoded(name: str, raw: bytes) -> str:
    if name.lower().endswith(".docx"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            xml = z.read("word/document.xml").decode("utf-8")
        paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
        import html

        return "\n".join(html.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S))) for p in paragraphs)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped): text files as one user message each; those under 50 characters are reported."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, raw, at in zip(f["path"], f["content"], f["modificationTime"]):
                stem = PurePosixPath(name).stem
                text = _decoded(name, bytes(raw))
                digest = hashlib.md5(name.encode()).hexdigest()[:8]
                rows.append((f"textfile_{stem}_{digest}", re.sub(r"[_-]+", " ", stem).title(), "user", text, len(text.strip()), at.timestamp()))
            if rows:
                yield pd.DataFrame(rows, columns=["conversation_id", "title", "role", "content_text", "n", "created_at"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(TEXT_SUFFIXES) + "}").load(path)
    rows = files.select("path", "content", "modificationTime").mapInPandas(parse, "conversation_id string, title string, role string, content_text string, n long, created_at double")
    return rows.where(F.col("n") >= LEAST_CHARS).drop("n"), rows.where(F.col("n") < LEAST_CHARS).select("conversation_id", "n")


def layer_text(text: Column) -> Column:
    """What a layer file says: after its injectable heading, else after its front matter, else all."""
    marked = F.instr(text, "## Injectable Block")
    ruled = F.instr(text, "\n---\n")
    after = F.when(marked > 0, F.regexp_replace(F.substr(text, marked), r"^## Injectable Block[^\n]*\n?", "")).when(ruled > 0, F.substr(text, ruled + 5)).otherwise(text)
    return F.trim(after, F.lit(" \n\t"))


def layer_files(spark: SparkSession, path: str) -> DataFrame:
    """(layer, text) of layer files."""
    t = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").text(path)
    return t.select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("layer"), layer_text(F.col("value")).alias("text"))


TREE = "root struct<themes:array<struct<statement:string,fact_ids:array<string>>>,singularities:array<struct<fact_id:string,verbatim:string,why:string>>,contradictions:array<struct<a_fact_ids:array<string>,b_fact_ids:array<string>,tension:string>>,dispositions:map<string,string>>, stamp string"


def distillation_trees(spark: SparkSession, path: str) -> DataFrame:
    """(path, root, stamp) of tree files; files without a root are left out."""
    t = spark.read.option("multiLine", "true").option("pathGlobFilter", "*.json").schema(TREE).json(path)
    return t.where("root IS NOT NULL").select(F.col("_metadata.file_path").alias("path"), "root", "stamp")


def correction_patterns(df: DataFrame, col: str) -> DataFrame:
    """(pattern) of JSON lists, lower-cased; a bad list is empty."""
    return df.select(F.explode(F.from_json(col, "array<string>")).alias("p")).select(F.lower("p").alias("pattern")).where("pattern <> ''")


def entity_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a user's JSON map: keys lower-cased, texts over 1000 characters dropped."""
    t = spark.read.option("wholetext", "true").text(path)
    return t.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value")).where(F.char_length("value") <= 1000).select(F.lower("name").alias("name"), "value")


def journal(spark: SparkSession, answers: list[tuple[str, str]], at: int) -> DataFrame:
    """One conversation of the answered prompts, each text led by its category."""
    rows = [(f"journal_{at}", k, "user", f"[{category}] {text}") for k, (category, text) in enumerate(a for a in answers if a[1].strip())]
    return spark.createDataFrame(rows, "conversation_id string, sequence_order int, role string, content_text string")


def detect_source(path: str, is_dir: bool = False) -> str:
    """Which reader a path is for, by its name."""
    name = PurePosixPath(path).name.lower()
    if name.endswith(".jsonl"):
        return "agent_sessions"
    if name == "conversations.json" or name.endswith(".zip") and "chat" in name:
        return "chat_tree_export"
    if name.endswith(".zip"):
        return "chat_list_export"
    if name.endswith(".json"):
        return "json_texts"
    return "text_files" if is_dir or name.endswith(TEXT_SUFFIXES) else "unknown"
