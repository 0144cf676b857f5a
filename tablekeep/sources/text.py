"""Legacy text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where windows-1252 differs from latin-1 (bytes 0x80-0x9F), by code point.
_CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def decode_bytes(raw: Column, charset: str = "windows-1252") -> Column:
    """Bytes to text. windows-1252 is latin-1 with another 0x80-0x9F block, so it needs neither a
    legacy switch of the engine nor Python."""
    name = charset.lower().replace("_", "-")
    if name in ("windows-1252", "win1252", "cp1252"):
        latin = F.decode(raw, "ISO-8859-1")
        return F.translate(latin, "".join(chr(c) for c in _CP1252), "".join(_CP1252.values()))
    return F.decode(raw, charset)


def decode_text(df: DataFrame, col: str, charset: str = "windows-1252") -> DataFrame:
    """``<col>_text`` from legacy bytes; bytes that are valid UTF-8 already are taken as such,
    and ``<col>_was_utf8`` tells which was which."""
    raw = F.col(col)
    utf8 = F.is_valid_utf8(raw.cast("string"))
    text = F.when(utf8, raw.cast("string")).otherwise(decode_bytes(raw, charset))
    return df.withColumn(f"{col}_text", text).withColumn(f"{col}_was_utf8", utf8)
