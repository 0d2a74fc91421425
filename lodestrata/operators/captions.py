"""Caption tracks: choice, cue parsing and rolling-cue collapse."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import bind, col

# The two patterns of the format, blocks that are no cues, and the messages.
TIMING = re.compile(r"(?:\d{2}:)?\d{2}:\d{2}\.\d{3}\s+-->\s+(?:\d{2}:)?\d{2}:\d{2}\.\d{3}(?:\s+.*)?")
VOICE = re.compile(r"<v(?:\.[^ >]+)*\s+([^>]+)>(.*?)</v>", re.S | re.I)

ASIDE = ("NOTE", "STYLE", "REGION")
NO_UTF8, NO_HEADER, MALFORMED, NO_CUES = "captions are not valid UTF-8", "missing WEBVTT header", "malformed WebVTT cue", "WebVTT contains no spoken cues"


def enriched(videos: DataFrame, *, payload: str = "payload", most: int = 64) -> DataFrame:
    """The caption tracks that a video's payload names: ``video_id, kind, language, format, name``, one row a track.

    ``subtitles`` are made by the creator, ``automatic_captions`` are not; both map a language to its tracks. A video with more than ``most``
    tracks is an error. A null payload, or one without tracks, gives no rows. Choose with ``choose``, then fetch the winners only.
    """
    v = F.try_parse_json(payload)
    kind = "map<string,array<struct<ext:string,name:string>>>"
    tracks = lambda path, name: F.flatten(F.transform(F.map_entries(F.coalesce(F.try_variant_get(v, path, kind), F.create_map().cast(kind))), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<struct<ext:string,name:string>>")), lambda t: F.struct(
        F.lit(name).alias("kind"), e["key"].alias("language"), t["ext"].alias("format"), t["name"].alias("name")))))
    every = F.concat(tracks("$.subtitles", "creator"), tracks("$.automatic_captions", "automatic"))
    out = videos.select(F.try_variant_get(v, "$.id", "string").alias("video_id"), every.alias("_t"))
    return out.select("video_id", F.explode(F.when(F.size("_t") > most, F.raise_error(F.lit(f"more than {most} caption tracks")).cast(out.schema["_t"].dataType)).otherwise(F.col("_t"))).alias("t")).select("video_id", "t.*")


def choose(tracks: DataFrame, *, on: str, languages: list[str], policy: str = "creator_then_automatic", base_fallback: bool = True) -> DataFrame:
    """The best track of each video: columns ``on, language, kind, format, name, reason``; no row if none is eligible.

    An exact language ranks 2i, its base 2i+1; the policy says whether kind or language comes first; VTT is preferred; ties
    go by language, then name. An aggregate with a struct key: combined map-side, no window.
    """
    lang = F.lower("language")
    rank = F.when(F.lit(False), 0)
    for i, p in enumerate(languages):
        rank = rank.when(lang == p.lower(), 2 * i)
        if base_fallback:
            rank = rank.when(F.split(lang, "-")[0] == p.lower().split("-")[0], 2 * i + 1)
    kind, fmt, name = F.when(F.col("kind") == "creator", 0).otherwise(1), F.when(F.lower("format") == "vtt", 0).otherwise(1), F.coalesce("name", F.lit(""))
    t = tracks.withColumn("_r", rank).where("_r IS NOT NULL")
    if policy == "creator_only":
        t = t.where("kind = 'creator'")
    first = [kind.alias("a"), F.col("_r").alias("b")] if policy == "creator_then_automatic" else [F.col("_r").alias("a"), kind.alias("b")]
    best = t.groupBy(on).agg(F.min_by(F.struct("language", "kind", "format", "name", "_r"), F.struct(*first, fmt.alias("c"), F.col("language").alias("d"), name.alias("e"))).alias("s"))
    match = F.when(F.col("s._r") % 2 == 0, "exact").otherwise("base-language-fallback")
    return best.select(on, "s.language", "s.kind", "s.format", "s.name", F.concat_ws(":", F.lit(policy), match, "s.language", "s.kind").alias("reason"))


def collapse(cues: str | Column, automatic: Column) -> Column:
    """Cues in order; of automatic tracks a cue that starts with the one kept last replaces it, repeats in a row go."""
    kept = F.filter(col(cues), lambda x: x.isNotNull() & (x != ""))
    # The cue kept last is always the one before: it was added, or replaced what it grew from. So a cue stays unless the next grows from it.
    gone = lambda p: F.coalesce(F.when(automatic, p["next"].startswith(p["x"])).otherwise(p["next"] == p["x"]), F.lit(False))
    pairs = bind(kept, lambda k: F.zip_with(k, F.slice(k, 2, 1 << 30), lambda x, n: F.struct(x.alias("x"), n.alias("next"))))
    return F.transform(F.filter(pairs, lambda p: ~gone(p)), lambda p: p["x"])


def _cues(data: bytes | None, automatic: bool) -> tuple[list[str] | None, str | None]:
    try:
        lines = unicodedata.normalize("NFC", (data or b"").decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")).split("\n")
    except UnicodeDecodeError:
        return None, NO_UTF8
    if lines[0].strip() != "WEBVTT":
        return None, NO_HEADER
    out: list[str] = []
    block: list[str] = []
    place = "header"  # then between cues, in a comment, timed (its text is awaited) or in a text
    for at, x in enumerate([*lines[1:], ""], 1):
        full = bool(x.strip())
        if place in ("header", "note"):
            place = place if full else "between"
        elif place == "between" and full:
            if x.startswith(ASIDE):
                place = "note"
            elif TIMING.fullmatch(x.strip()):
                place = "timed"
            elif at + 1 < len(lines) and TIMING.fullmatch(lines[at + 1].strip()):
                place = "named"
            else:
                return None, MALFORMED
        elif place == "named":
            place = "timed"
        elif place == "timed" and not full and automatic and at + 1 < len(lines) and lines[at + 1].strip() and not TIMING.fullmatch(lines[at + 1].strip()):
            place = "text"  # one empty line before the text, whatever the text begins with
        elif place in ("timed", "text"):
            if full:
                place = "text"
                block.append(x)
                continue
            text = VOICE.sub(lambda m: f"**{m[1].strip()}:** {m[2]}", " ".join(y.strip() for y in block))
            text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", text)).split())
            if text:
                out.append(text)
            block, place = [], "between"
    return (out, None) if out else (None, NO_CUES)


def parse(tracks: DataFrame, *, id_col: str, data: str = "data", automatic: str = "automatic") -> DataFrame:
    """``id, cues, problem``: the cleaned cues of each WebVTT file in order, or what is wrong with it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *_cues(d, bool(a))) for i, d, a in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2])]
            yield pd.DataFrame(rows, columns=["id", "cues", "problem"])

    return tracks.select(id_col, data, automatic).mapInPandas(run, f"id {tracks.schema[id_col].dataType.simpleString()}, cues array<string>, problem string")


def playlist_order(entries: DataFrame) -> list[Column]:
    """Sort keys of a playlist: by position, those without one last, then by id."""
    return [F.col("position").asc_nulls_last(), F.col("video_id").asc()]
