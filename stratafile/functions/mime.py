"""Media types by content: a trie of byte signatures, and a closer look into containers that many formats share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that are read of a file.
HEAD = 4096

# Fixed values: (offset, signature, media type); two question marks stand for any byte.
SIGNATURES = [
    (0, "89504E470D0A1A0A", "image/png"), (0, "FFD8FF", "image/jpeg"), (0, "474946383761", "image/gif"), (0, "474946383961", "image/gif"), (0, "424D", "image/bmp"), (0, "49492A00", "image/tiff"), (0, "4D4D002A", "image/tiff"),
    (0, "00000100", "image/vnd.microsoft.icon"), (0, "38425053", "image/vnd.adobe.photoshop"), (0, "FF0A", "image/jxl"), (0, "0000000C4A584C200D0A870A", "image/jxl"), (0, "0000000C6A5020200D0A870A", "image/jp2"),
    (0, "52494646????????57454250", "image/webp"), (0, "52494646????????57415645", "audio/x-wav"), (0, "52494646????????41564920", "video/x-msvideo"), (0, "464F524D????????41494646", "audio/aiff"),
    (0, "494433", "audio/mpeg"), (0, "FFFB", "audio/mpeg"), (0, "FFF3", "audio/mpeg"), (0, "664C6143", "audio/flac"), (0, "4F676753", "application/ogg"), (0, "4D546864", "audio/midi"),
    (0, "1A45DFA3", "video/x-matroska"), (0, "464C5601", "video/x-flv"), (0, "000001BA", "video/mpeg"), (0, "000001B3", "video/mpeg"), (0, "3026B2758E66CF11A6D900AA0062CE6C", "video/x-ms-asf"), (4, "66747970", "video/mp4"),
    (0, "255044462D", "application/pdf"), (0, "25215053", "application/postscript"), (0, "7B5C727466", "application/rtf"), (0, "D0CF11E0A1B11AE1", "application/x-ole-storage"),
    (0, "504B0304", "application/zip"), (0, "504B0506", "application/zip"), (0, "1F8B", "application/gzip"), (0, "425A68", "application/x-bzip2"), (0, "FD377A585A00", "application/x-xz"), (0, "28B52FFD", "application/zstd"), (0, "04224D18", "application/x-lz4"),
    (0, "377ABCAF271C", "application/x-7z-compressed"), (0, "526172211A07", "application/vnd.rar"), (257, "7573746172", "application/x-tar"), (0, "4D534346", "application/vnd.ms-cab-compressed"), (32769, "4344303031", "application/x-iso9660-image"),
    (0, "7F454C46", "application/x-elf"), (0, "4D5A", "application/x-dosexec"), (0, "CAFEBABE", "application/java-vm"), (0, "FEEDFACE", "application/x-mach-binary"), (0, "FEEDFACF", "application/x-mach-binary"), (0, "CFFAEDFE", "application/x-mach-binary"), (0, "0061736D", "application/wasm"),
    (0, "53514C69746520666F726D6174203300", "application/vnd.sqlite3"), (0, "50415231", "application/vnd.apache.parquet"), (0, "4F626A01", "application/avro"), (0, "4152524F5731", "application/vnd.apache.arrow.file"), (0, "894844460D0A1A0A", "application/x-hdf5"),
    (0, "774F4646", "font/woff"), (0, "774F4632", "font/woff2"), (0, "0001000000", "font/ttf"), (0, "4F54544F", "font/otf"), (0, "EFBBBF", "text/plain"), (0, "2321", "text/x-script"),
]
# Brands of ISO media files.
BRANDS = {b"qt  ": "video/quicktime", b"heic": "image/heic", b"heix": "image/heic", b"mif1": "image/heif", b"msf1": "image/heif", b"avif": "image/avif", b"avis": "image/avif", b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"M4V ": "video/x-m4v", b"3gp4": "video/3gpp", b"3gp5": "video/3gpp", b"crx ": "image/x-canon-cr3"}
# What the first entries of a ZIP archive are called.
ENTRIES = [("word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), ("ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), ("META-INF/MANIFEST.MF", "application/java-archive"), ("AndroidManifest.xml", "application/vnd.android.package-archive")]

ANY = -1


class Trie:
    """Signatures of one offset: a node is a dictionary of the next byte's node, ANY for any byte, and None for the type that ends here."""

    def __init__(self):
        self.root: dict = {}

    def add(self, signature: str, kind: str) -> None:
        node = self.root
        for i in range(0, len(signature), 2):
            two = signature[i : i + 2]
            node = node.setdefault(ANY if two == "??" else int(two, 16), {})
        node[None] = kind

    def longest(self, data: bytes, at: int) -> tuple[int, str | None]:
        """(bytes, type) of the longest signature that data has at an offset."""
        best, nodes, n = (0, None), [self.root], 0
        while nodes:
            for node in nodes:
                if None in node:
                    best = (n, node[None])
            if at + n >= len(data):
                break
            nodes = [x for node in nodes for x in (node.get(data[at + n]), node.get(ANY)) if x is not None]
            n += 1
        return best


def tries(signatures=SIGNATURES) -> dict[int, Trie]:
    out: dict[int, Trie] = {}
    for offset, signature, kind in signatures:
        out.setdefault(offset, Trie()).add(signature, kind)
    return out


_TRIES = tries()


def _in_zip(head: bytes) -> str:
    """What a ZIP archive holds, by the names of the entries at its beginning."""
    names, at = [], 0
    while head[at : at + 4] == b"PK\x03\x04" and len(head) >= at + 30:
        size, name, extra = (int.from_bytes(head[i : i + n], "little") for i, n in ((at + 18, 4), (at + 26, 2), (at + 28, 2)))
        names.append(head[at + 30 : at + 30 + name].decode("utf-8", "replace"))
        body = at + 30 + name + extra
        if names[0] == "mimetype":
            kind = head[body : body + size].decode("ascii", "replace")
            return kind if "/" in kind and kind.isprintable() else "application/zip"
        at = body + size
        if not size:  # the size follows the data: the next entry is found by its mark
            at = head.find(b"PK\x03\x04", body)
            if at < 0:
                break
    return next((kind for start, kind in ENTRIES if any(n.startswith(start) for n in names)), "application/zip")


def _text(head: bytes, cut: bool) -> str:
    """The type of what no signature fits: text of some kind, or bytes."""
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError as e:
        if not cut or e.start < len(head) - 4:
            if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
                return "text/plain"
            return "application/octet-stream"
        text = head[: e.start].decode("utf-8")
    if any(ord(c) < 32 and c not in "\t\n\v\f\r\x1b\b" for c in text):
        return "application/octet-stream"
    low = text.lstrip().lower()
    if low.startswith(("<!doctype html", "<html")):
        return "text/html"
    if low.startswith("<svg") or low.startswith("<?xml") and "<svg" in low:
        return "image/svg+xml"
    if low.startswith("<?xml"):
        return "text/html" if "<html" in low else "text/xml"
    return "text/plain"


def mime_of(head: bytes, cut: bool = False) -> str:
    """The media type of a file that begins with these bytes; cut: it goes on. The longest signature counts, of equal ones that at the smaller offset."""
    if not head:
        return "inode/x-empty"
    best = (0, None)
    for offset in sorted(_TRIES):
        found = _TRIES[offset].longest(head, offset)
        if found[0] > best[0]:
            best = found
    kind = best[1]
    if kind == "application/zip":
        return _in_zip(head)
    if kind == "video/mp4":
        return BRANDS.get(head[8:12], kind)
    if kind == "video/x-matroska":
        return "video/webm" if b"webm" in head[:64] else kind
    if best[0] <= 2 and kind in ("image/bmp", "application/x-dosexec", "image/jxl") and _text(head, cut).startswith("text/"):
        return _text(head, cut)  # two letters begin many texts
    return kind or _text(head, cut)


def mime_type(content: Column) -> Column:
    """The media type of a column of texts or bytes; null for null. Only the first HEAD bytes go to Python."""

    @F.pandas_udf("string")
    def run(head: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else mime_of(bytes(h), n > HEAD) for h, n in zip(head, size)], dtype=object)

    data = content.cast("binary")
    return run(F.substring(data, 1, HEAD), F.coalesce(F.octet_length(data), F.lit(0)))


def with_mime_types(files: DataFrame, path: str = "abs_path") -> DataFrame:
    """files with mime_type by what their paths hold; links and files that can't be read keep what they have. Each row opens its file once, for HEAD bytes."""

    def kind(p: str, link: bool, was: str | None) -> str | None:
        if link:
            return was
        try:
            with open(p, "rb") as f:
                head = f.read(HEAD)
                return mime_of(head, bool(f.read(1)))
        except (OSError, TypeError):
            return was

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(mime_type=pd.Series([kind(p, bool(x), w) for p, x, w in zip(b[path], b["is_symlink"], b["mime_type"])], dtype=object, index=b.index))

    slim = files.select("id", path, "is_symlink", "mime_type").mapInPandas(run, f"id long, `{path}` string, is_symlink boolean, mime_type string")
    return files.drop("mime_type").join(slim.select("id", "mime_type"), "id").select(*files.columns)
