"""Readers for folders of files, mail, archives, HTML and golden sets, and a registry of extractors."""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, extension, strip_tags
from ..operators.ingest import discover
from ..session import bounded_batches, sized

#: Elements without visible text. Fixed values.
SKIPPED = frozenset("script style noscript svg math template head iframe object embed".split())
#: Elements that break lines. Fixed values.
BREAKS = frozenset((
    "p div section article main aside header footer nav h1 h2 h3 h4 h5 h6 blockquote pre ul ol li table tr td th caption"
    " dl dt dd figure figcaption details summary form fieldset hr br").split())
#: What parts the messages of a mail archive. Fixed value.
BORDER = b"\nFrom "
VOID = frozenset("meta link br hr img input embed source track wbr area base col param".split())


def scan_corpus(spark: SparkSession, root: str, extensions: list[str], excluded: list[str], content: bool = False) -> DataFrame:
    """Files below a folder: path, modificationTime, length, and the content if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    columns = ["path", "modificationTime", "length"] + ["content"] * content
    return discover(files.select(columns), extensions, excluded)


def fingerprint(files: DataFrame) -> DataFrame:
    """Adds ``file_hash``: size and modification time in nanoseconds."""
    return files.withColumn("file_hash", F.concat_ws(":", "length", F.unix_micros("modificationTime") * 1000))


def read_text(files: DataFrame) -> DataFrame:
    """Adds ``text``, with bad bytes replaced, and ``valid``, whether there were none."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("valid", F.is_valid_utf8(F.col("content").cast("string")))


class _Visible(HTMLParser):
    """Collects visible text and the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.depth, self.in_title = 0, False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED and tag not in VOID:
            self.depth += 1
        self.in_title |= tag == "title"
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED and tag not in VOID and self.depth:
            self.depth -= 1
        if tag == "title":
            self.in_title = False
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.depth:
            self.parts.append(data)


def _visible(html: pd.Series) -> pd.DataFrame:
    rows = []
    for page in html:
        parser = _Visible()
        try:
            parser.feed(page or "")
            parser.close()
            rows.append(("".join(parser.parts), "".join(parser.title).strip(), None))
        except Exception as e:  # a broken page becomes an error row, its text by the plainer way
            rows.append((" ".join(re.sub(r"<[^>]+>", " ", page).split()), None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["raw", "title", "error"])


def extract_html(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text``, ``title``, ``html_length``, ``text_length``, ``compression_ratio`` and ``error``.

    A page that can't be parsed has an ``error`` and its text without tags.
    """
    df = pages.withColumn("__v", F.pandas_udf(_visible, "struct<raw:string,title:string,error:string>")(column)).withColumn("text", collapse(F.coalesce("__v.raw", F.lit(""))))
    n = F.char_length(F.coalesce(F.col(column), F.lit("")))
    return df.select(*pages.columns, "text", F.col("__v.title").alias("title"), n.alias("html_length"), F.char_length("text").alias("text_length"), F.when(n > 0, F.char_length("text") / n).otherwise(0.0).alias("compression_ratio"), F.col("__v.error").alias("error"))


def _mail_row(data: bytes) -> dict:
    out = {"subject": None, "sender": None, "recipients": None, "date": None, "body": "", "html": False, "attachments": 0, "sha1": hashlib.sha1(data).hexdigest(), "status": "ok"}
    try:
        m = email.message_from_bytes(data, policy=email.policy.default)
        out |= {"subject": m["subject"], "sender": m["from"], "recipients": m["to"], "date": m["date"], "attachments": sum(1 for _ in m.iter_attachments())}
        part = m.get_body(("plain",)) or m.get_body(("html",))
        if part is None:
            out["status"] = "no_body"
        else:
            text = part.get_content()
            out["body"], out["html"] = text, part.get_content_type() == "text/html"
    except Exception as e:
        out["status"] = f"error: {type(e).__name__}"
    return {k: str(v) if v is not None and k not in ("attachments", "html") else v for k, v in out.items()}


MAIL = "subject string, sender string, recipients string, date string, body string, html boolean, attachments int, sha1 string, status string"


def _plain_body(mails: DataFrame) -> DataFrame:
    """HTML bodies as their visible text."""
    return mails.withColumn("body", F.when(F.col("html"), strip_tags(F.col("body"))).otherwise(F.col("body"))).drop("html")


def parse_mail(files: DataFrame) -> DataFrame:
    """``(path, content)`` messages as header, body (plain before HTML), attachment count and status columns."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"path": p} | _mail_row(c) for p, c in zip(frame.path, frame.content, strict=True)], columns=["path", *(x.split()[0] for x in MAIL.split(", "))])
    bounded_batches(files.sparkSession)
    return _plain_body(files.select("path", "content").mapInPandas(run, f"path string, {MAIL}"))


def _unframed(piece: bytes, last: bool) -> bytes:
    """A message from what stands between two borders: without the rest of its border line and the blank line at its end."""
    message = piece[piece.find(b"\n") + 1 :] if b"\n" in piece else b""
    message += b"" if last or b"\n" not in piece else b"\n"  # the next border's line break
    return message[:-1] if message == b"\n" or message.endswith(b"\n\n") else message


def _shortened(mails: DataFrame, body: int | None) -> DataFrame:
    return _plain_body(mails).withColumn("body", F.left("body", F.lit(body))) if body is not None else _plain_body(mails)


def explode_mbox(files: DataFrame, most: int | None = 200, body: int | None = 5000) -> DataFrame:
    """One row per message of mail archives ``(path, content)``; both limits are the feature's own, None lifts them.

    An archive is one row, so one task's; ``read_mailboxes`` cuts stored ones by byte ranges.
    """
    names = ["path", "message", *(x.split()[0] for x in MAIL.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content, strict=True):
                pieces = (b"\n" + bytes(content or b"")).split(BORDER)[1:]  # what comes before the first border is no message
                rows = [{"path": path, "message": k} | _mail_row(_unframed(piece, k == len(pieces) - 1)) for k, piece in enumerate(pieces[:most])]
                yield pd.DataFrame(rows, columns=names)

    bounded_batches(files.sparkSession)
    return _shortened(files.select("path", "content").mapInPandas(run, f"path string, message int, {MAIL}"), body)


def read_mailboxes(spark: SparkSession, root: str, pattern: str = "*.mbox", most: int | None = 200, body: int | None = 5000) -> DataFrame:
    """One row per message of the mail archives below a folder, as ``explode_mbox`` gives them.

    Archives are cut into byte ranges of ``spark.sql.files.maxPartitionBytes``
    that meet at message borders, so a large one is many tasks' work. A first
    pass counts the messages of each range; the second knows from that each
    message's number in its archive, and no message is shuffled.

    * text before the first border is no message; an empty archive gives no rows;
    * a message that can't be parsed has its ``status``; bytes that aren't UTF-8 reach the parser unchanged;
    * a message is one row, however long.
    """
    pieces = spark.read.option("lineSep", BORDER.decode()).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("place"))
    ranges = pieces.groupBy("path", "range").agg(F.count("*").alias("n"), F.min(F.struct("place", F.col("value").startswith("From ").alias("border"))).alias("first"))
    ahead, whole = Window.partitionBy("path").orderBy("range"), Window.partitionBy("path")  # one row for each range
    framed = F.first("first.border").over(ahead)  # whether the archive begins with a message
    before = F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("path", "range", (before - F.col("first.place") - F.when(framed, 0).otherwise(1)).alias("shift"), (F.sum("n").over(whole) - F.when(framed, 1).otherwise(2)).alias("final"))
    numbered = pieces.join(sized(starts, "mailboxes"), ["path", "range"]).withColumn("message", F.col("place") + F.col("shift")).where("message >= 0")
    if most is not None:
        numbered = numbered.where(F.col("message") < most)
    content = F.col("value").cast("binary")
    numbered = numbered.select("path", F.col("message").cast("int").alias("message"), content.alias("content"), (F.col("message") == F.col("final")).alias("last"))
    names = ["path", "message", *(x.split()[0] for x in MAIL.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": r.path, "message": r.message} | _mail_row(_unframed(bytes(r.content), r.last)) for r in frame.itertuples()]
            yield pd.DataFrame(rows, columns=names)

    bounded_batches(spark)
    return _shortened(numbered.mapInPandas(run, f"path string, message int, {MAIL}"), body)


def read_golden(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON list of golden questions, by id; the first ``limit`` if asked for."""
    schema = "id string, type string, query string, expected_key_facts array<string>"
    df = spark.read.schema(schema).json(path, multiLine=True).orderBy("id")
    return df.limit(limit) if limit else df


def write_records(df: DataFrame, path: str, checkpoint: str | None = None):
    """Appends JSON lines; a stream, which needs a ``checkpoint``, is drained and its finished query returned."""
    if not df.isStreaming:
        df.write.mode("append").json(path)
        return None
    query = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


Extractor = Callable[[DataFrame], DataFrame]
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(ext: str, extractor: Extractor) -> None:
    """``extractor`` takes ``(path, content)`` rows of one extension and returns ``(path, text, details, error)``."""
    _EXTRACTORS[ext.lower()] = extractor


def registered() -> list[str]:
    return sorted(_EXTRACTORS)


def _text_extractor(files: DataFrame) -> DataFrame:
    return read_text(files).select("path", "text", F.create_map(F.lit("valid"), F.col("valid").cast("string")).alias("details"), F.lit(None).cast("string").alias("error"))


def _html_extractor(files: DataFrame) -> DataFrame:
    pages = extract_html(read_text(files).select("path", F.col("text").alias("html")))
    return pages.select("path", "text", F.create_map(F.lit("title"), "title").alias("details"), "error")


def _mail_extractor(files: DataFrame) -> DataFrame:
    return parse_mail(files).select("path", F.col("body").alias("text"), F.create_map(F.lit("subject"), "subject").alias("details"), F.when(F.col("status").startswith("error"), F.col("status")).alias("error"))


for _ext in (".txt", ".md", ".csv", ".log", ".json"):
    register_extractor(_ext, _text_extractor)
register_extractor(".html", _html_extractor)
register_extractor(".eml", _mail_extractor)


def with_extractors(extractors: dict[str, Extractor]) -> dict[str, Extractor]:
    """The registered extractors and the given ones, without registering those."""
    return _EXTRACTORS | {ext.lower(): f for ext, f in extractors.items()}


def each_file(read: Callable[[bytes], tuple[str, dict]]) -> Extractor:
    """An extractor from a function of one file's content; a file on which it fails becomes an error row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    text, details = read(content)
                    rows.append((path, text, {k: str(v) for k, v in details.items()}, None))
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "details", "error"])

    return lambda files: files.select("path", "content").mapInPandas(run, "path string, text string, details map<string,string>, error string")


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """``(path, text, details, error)`` of all files, each extension by its extractor, unknown ones as error rows."""
    ext, extractors = extension(F.col("path")), extractors or _EXTRACTORS
    known = [f(files.where(ext == e).select("path", "content")) for e, f in sorted(extractors.items())]
    other = files.where(~ext.isin(*extractors)).select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("map<string,string>").alias("details"), F.lit("no extractor").alias("error"))
    for part in known:
        other = other.unionByName(part)
    return other


def register_lines(spark: SparkSession, name: str = "loomspan_lines") -> None:
    """A table function for lateral joins in SQL: the lines of a text as ``(nth, line)``."""
    class Lines:
        def eval(self, text: str):
            if text is not None:
                yield from enumerate(text.split("\n"))

    spark.udtf.register(name, F.udtf(Lines, returnType="nth long, line string"))
