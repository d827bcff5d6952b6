"""Parsers of fetched payloads (S1-S6) and of imported posts.

Payloads are small documents, one per row, so a parser is a function from one payload to its items, run over Arrow
batches; a payload that can't be read gives one row with an error and no item, and never stops the job.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import datetime
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.urls import domain_of

ITEM = "url string, title string, published_at string, summary string, author string, publisher_name string, publisher_domain string, language_hint string, extra map<string,string>, error string"
FIELDS = ["url", "title", "published_at", "summary", "author", "publisher_name", "publisher_domain", "language_hint", "extra", "error"]
# Language names of the JSON news index.
LANGUAGE_NAMES = {"english": "en", "arabic": "ar", "french": "fr", "german": "de", "spanish": "es", "turkish": "tr", "persian": "fa", "russian": "ru", "chinese": "zh", "italian": "it", "urdu": "ur", "hebrew": "he"}
# The names that XML itself defines, and the characters that it doesn't allow.
STRICT_NAMES = {"amp", "lt", "gt", "quot", "apos"}
UNPRINTED = {c: None for c in range(0x20) if chr(c) not in "\t\n\r"}


def _ampersand(piece: str) -> str:
    """What stands behind an ampersand, as a strict parser takes it: references it knows stay, others become numbers or text."""
    name, semicolon, rest = piece.partition(";")
    if semicolon and (name.startswith("#") and name[1:].removeprefix("x").isalnum() or name in STRICT_NAMES):
        return f"&{piece}"
    known = html5.get(f"{name};") if semicolon and name.isalnum() else None
    return "".join(f"&#{ord(c)};" for c in known) + rest if known else f"&amp;{piece}"


def repair_xml(payload: bytes) -> str:
    """Text that a strict parser takes: declared encoding, references it knows, no control characters.

    One pass over the pieces between ampersands.
    """
    declared = re.search(rb'encoding=["\']([A-Za-z0-9._-]+)', payload[:200])
    try:
        text = payload.decode(declared[1].decode() if declared else "utf-8", errors="replace")
    except LookupError:
        text = payload.decode("utf-8", errors="replace")
    if text.lstrip().startswith("<?xml"):
        text = text.partition("?>")[2]
    first, *others = text.translate(UNPRINTED).split("&")
    return first + "".join(map(_ampersand, others))


def _plain(text: str | None) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text or "")).split())


def _shorten(text: str, most: int, mark: str) -> str:
    return text if len(text) <= most else re.sub(r" [^ ]*$", "", text[:most]) + mark


def _row(**values) -> dict:
    return dict.fromkeys(FIELDS) | values


def _children(node: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in node if x.tag.rsplit("}", 1)[-1] in names]


def _text(node: ET.Element, *names: str) -> str | None:
    for name in names:
        for x in _children(node, name):
            if (x.text or "").strip():
                return x.text.strip()
    return None


def _root(payload: bytes) -> ET.Element:
    try:
        return ET.fromstring(payload)
    except ET.ParseError:
        return ET.fromstring(repair_xml(payload))


def parse_rss(payload: bytes) -> list[dict]:
    """RSS and Atom (S1): items with a link and a title; the first content where there is no summary; at most ten tags."""
    root = _root(payload)
    nodes = [x for x in root.iter() if x.tag.rsplit("}", 1)[-1] in ("item", "entry")]
    if not nodes and root.tag.rsplit("}", 1)[-1] not in ("rss", "feed", "RDF"):
        raise ValueError("no feed")
    hint = next((x.text for x in root.iter() if x.tag.rsplit("}", 1)[-1] == "language" and x.text), None) or root.get("{http://www.w3.org/XML/1998/namespace}lang") or ""
    out = []
    for n in nodes:
        links = [x.get("href") for x in _children(n, "link") if x.get("href") and x.get("rel", "alternate") == "alternate"]
        url, title = _text(n, "link") or (links[0] if links else None), _plain(_text(n, "title"))
        if not url or not title:
            continue
        group = [y for x in _children(n, "group") for y in _children(x, "description")]
        body = _text(n, "description", "summary") or _text(n, "encoded", "content") or (group[0].text if group else "")
        author = _text(n, "creator") or next((_text(x, "name") for x in _children(n, "author") if _text(x, "name")), None) or _text(n, "author")
        tags = [t for x in _children(n, "category") if (t := (x.text or x.get("term") or "").strip())][:10]
        out.append(_row(url=url, title=title, published_at=_text(n, "pubDate", "published", "date", "updated"), summary=_shorten(_plain(body), 600, " …"), author=author, language_hint=hint.strip()[:2].lower() or None, extra={"tags": ",".join(tags)} if tags else {}))
    return out


#: A publisher of 2 to 80 characters, without a hyphen, at the end of an aggregator's headline.
PUBLISHER = re.compile(r"\s+-\s+(?P<publisher>[^-]{2,80})$")


def parse_aggregator(payload: bytes) -> list[dict]:
    """Items of an aggregator's feed (S3): the publisher leaves the headline and becomes a field, the summary is dropped."""
    out = []
    root = _root(payload)
    for n in (x for x in root.iter() if x.tag.rsplit("}", 1)[-1] == "item"):
        url, title = _text(n, "link"), _plain(_text(n, "title"))
        if not url or not title:
            continue
        source = next(iter(_children(n, "source")), None)
        name = (source.text or "").strip() if source is not None else ""
        ending = PUBLISHER.search(title)
        if ending and name in ("", ending["publisher"].strip()):
            title, name = title[: ending.start()].strip(), name or ending["publisher"].strip()
        home = source.get("url") if source is not None else None
        site = re.sub(r"^https?://(?:www\.)?([^/:]+).*$", r"\1", source.get("url", "")) if source is not None else None
        out.append(_row(url=url, title=title, published_at=_text(n, "pubDate"), summary="", publisher_name=name or None, publisher_domain=site or None, extra={k: v for k, v in (("aggregator", "headlines"), ("publisher_url", home)) if v}))
    return out


def parse_index(payload: bytes) -> list[dict]:
    """Articles of a JSON news index (S4); their date is when they were seen."""
    out = []
    for a in json.loads(payload.decode("utf-8")).get("articles", []):
        if not a.get("url") or not a.get("title"):
            continue
        try:
            at = datetime.strptime(a.get("seendate", ""), "%Y%m%dT%H%M%SZ").strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            at = None
        out.append(_row(url=a["url"], title=_plain(a["title"]), published_at=at, summary="", publisher_domain=a.get("domain"), language_hint=LANGUAGE_NAMES.get((a.get("language") or "").lower()), extra={"date_is": "seen"}))
    return out


class _Preview(HTMLParser):
    """The messages of a channel's preview page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.posts: list[dict] = []
        self.depth, self.text_at, self.reply_at, self.page = 0, None, None, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "br":
            if self.text_at is not None and self.reply_at is None:
                self.posts[-1]["text"] += "\n"
            return
        if tag in ("img", "meta", "link", "input", "hr"):
            return
        self.depth += 1
        self.page |= any(c.startswith("tgme_") for c in classes)
        if "tgme_widget_message" in classes and a.get("data-post"):
            self.posts.append({"post": a["data-post"], "text": "", "at": None})
        elif self.posts:
            if "tgme_widget_message_reply" in classes and self.reply_at is None:
                self.reply_at = self.depth
            if "tgme_widget_message_text" in classes and self.reply_at is None:
                self.text_at = self.depth
            if tag == "time" and a.get("datetime"):
                self.posts[-1]["at"] = a["datetime"]

    def handle_endtag(self, tag):
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        if self.text_at == self.depth:
            self.text_at = None
        if self.reply_at == self.depth:
            self.reply_at = None
        self.depth -= 1

    def handle_data(self, data):
        if self.text_at is not None and self.reply_at is None:
            self.posts[-1]["text"] += data


def parse_preview(payload: bytes) -> list[dict]:
    """Posts of a channel's preview page (S5): no quoted replies, no posts without text; the first line is the title."""
    p = _Preview()
    p.feed(payload.decode("utf-8", errors="replace"))
    if not p.page:
        raise ValueError("no channel preview")
    out = []
    for post in p.posts:
        lines = [" ".join(x.split()) for x in post["text"].split("\n")]
        text = "\n".join(x for x in lines if x)
        if text:
            out.append(_row(url=f"https://t.me/{post['post']}", title=_shorten(text.split("\n")[0], 140, "…"), published_at=post["at"], summary=_shorten(text, 600, " …"), extra={}))
    return out


PARSERS: dict[str, Callable[[bytes], list[dict]]] = {"rss": parse_rss, "atom": parse_rss, "video_channel": parse_rss, "aggregator": parse_aggregator, "index": parse_index, "channel_preview": parse_preview}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for feed, kind, payload in zip(b["feed_id"], b["feed_type"], b["payload"]):
            try:
                rows = PARSERS.get(kind, parse_rss)(bytes(payload) if payload is not None else b"")
            except Exception as e:  # noqa: BLE001 - one bad payload is one error row
                rows = [_row(error=f"{type(e).__name__}: {e}"[:300])]
            out += [{"feed_id": feed} | r for r in rows]
        frame = pd.DataFrame(out, columns=["feed_id", *FIELDS])
        yield frame


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Items of payloads (feed_id, feed_type, payload binary) by their type; unknown types are read as RSS."""
    return payloads.select(F.col("feed_id").cast("long").alias("feed_id"), "feed_type", "payload").mapInPandas(_parse, "feed_id long, " + ITEM)


def read_posts(spark, path: str) -> DataFrame:
    """Posts from CSV with a header or from a JSON list."""
    schema = "source string, url string, posted_at string, text string, language string"
    if path.endswith(".json"):
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def check_posts(posts: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Posts with the first reason to reject them, null for good ones (S9).  ``sources``: slug, url, domain."""
    known = sources.select(F.col("slug").alias("source"), F.col("url").alias("home"), "domain")
    p = posts.join(known, "source", "left").withColumn("at", F.try_to_timestamp(F.col("posted_at")))
    home = F.regexp_replace(F.lower("home"), "/+$", "")
    own = F.when(F.col("home").contains("@"), F.lower("url").startswith(home)).otherwise(domain_of(F.col("url")) == F.lower("domain"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(F.col("home").isNull(), "unknown source").when(blank("url"), "no address").when(blank("text"), "no text").when(blank("posted_at"), "no date")
        .when(F.col("at").isNull(), "date can't be read").when(F.col("at") > now + F.expr("interval 6 hours"), "date in the future").when(~F.coalesce(own, F.lit(False)), "address of another account")
    )
    return p.select(*posts.columns, reason.alias("reason"))


def read_vocabulary(spark, path: str, kind: str) -> DataFrame:
    """A vocabulary file (JSON; YAML where a reader is installed) as (class, language, term).

    ``kind`` is the key below which classes map languages to lists of terms.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        content = yaml.safe_load(text)
    else:
        content = json.loads(text)
    rows = [(c, lang, str(t)) for c, by in content[kind].items() for lang, terms in by.items() for t in terms]
    return spark.createDataFrame(rows, "class string, language string, term string")
