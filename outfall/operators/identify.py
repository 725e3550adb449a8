"""What a file is: type, architecture, container format.  Projections on the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.functions.text import printable_ratio
from outfall.operators.extract import latin1

# Signatures, machine numbers and container tables, in test order.
SIGNATURES = (
    ("4D5A", "pe", "application/vnd.microsoft.portable-executable"),
    ("7F454C46", "elf", "application/x-elf"),
    ("CAFEBABE", "macho", "application/x-mach-binary"),
    ("CFFAEDFE", "macho", "application/x-mach-binary"),
    ("504B0304", "archive", "application/zip"),
    ("377ABCAF271C", "archive", "application/x-7z-compressed"),
    ("1F8B", "archive", "application/gzip"),
    ("68737173", "filesystem", "application/x-squashfs"),
    ("D0CF11E0", "installer", "application/x-msi"),
    ("2D2D2D2D2D424547494E", "certificate", "application/x-pem-file"),
)
PE_MACHINES = {0x014C: "x86", 0x8664: "x86_64", 0x01C0: "arm", 0xAA64: "arm64", 0x0200: "ia64"}
ELF_MACHINES = {0x03: "x86", 0x3E: "x86_64", 0x28: "arm", 0xB7: "arm64", 0x08: "mips", 0xF3: "riscv"}
HEADER_BYTES = 4096
CONTAINER_MAGIC = (
    (0, "377ABCAF271C", "7z"), (0, "526172211A07", "rar"), (0, "4D534346", "cab"), (0, "68737173", "squashfs"),
    (0, "73717368", "squashfs"), (0, "FD377A585A00", "xz"), (0, "425A68", "bzip2"), (0, "1F8B", "gzip"),
    (0, "D0CF11E0A1B11AE1", "msi"), (0, "303730373031", "cpio"), (0, "303730373037", "cpio"), (257, "7573746172", "tar"),
    (0x8001, "4344303031", "iso"), (0, "504B0304", "zip"), (0, "504B0506", "zip"),
)
ZIP_FAMILY = {
    ".jar": "jar", ".war": "jar", ".ear": "jar", ".apk": "apk", ".aab": "apk", ".ipa": "zip", ".whl": "zip", ".nupkg": "zip",
    ".vsix": "zip", ".xpi": "zip", ".docx": "zip", ".xlsx": "zip", ".pptx": "zip", ".appx": "zip",
}
BY_EXTENSION = {".asar": "asar", ".tgz": "gzip", ".tbz2": "bzip2", ".txz": "xz", ".dmg": "dmg"}
PE_MARKERS = (
    ("Nullsoft", "nsis"), ("NullsoftInst", "nsis"), ("Inno Setup", "inno"), ("JR.Inno.Setup", "inno"), ("_MEIPASS", "pyinstaller"),
    ("MEI\x0c\x0b\x0a\x0b\x0e", "pyinstaller"), ("PyInstaller", "pyinstaller"),
)
SNIFF_BYTES = 0x8100
TAIL_BYTES = 512 * 1024
OVERLAY_BYTES = 256 * 1024
UNPACK_CONFIDENCE = 0.5


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written once, however often the body reads it.

    Filters on the results below are pushed through the projections; without
    this the substituted expression would grow with every stage.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bytes(content: Column, at: Column | int, count: int) -> Column:
    """Bytes at a 0-based position as hex; empty beyond the end or for absurd positions."""
    if isinstance(at, int):
        return F.hex(F.substring(content, at + 1, count))
    size = F.octet_length(content)
    return bind(at.cast("bigint"), lambda p: F.when((p >= 0) & (p < size), F.hex(F.substring(content, p.cast("int") + 1, F.lit(count)))).otherwise(F.lit("")))


def _number(hexed: Column, count: int, little: Column | bool = True) -> Column:
    """An unsigned number from ``count`` bytes of hex; null when bytes are missing."""
    def read(h: Column) -> Column:
        swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(count))])
        digits = swapped if little is True else F.when(little, swapped).otherwise(h)
        return F.when(F.length(h) == 2 * count, F.conv(digits, 16, 10).cast("bigint"))

    return bind(hexed, read)


def _name(number: Column, names: dict[int, str], digits: int) -> Column:
    def look_up(n: Column) -> Column:
        out = F.when(n.isNotNull(), F.concat(F.lit("unknown(0x"), F.lower(F.lpad(F.hex(n), digits, "0")), F.lit(")")))
        for value, name in names.items():
            out = F.when(n == value, name).otherwise(out)
        return out

    return bind(number, look_up)


def looks_like_text(content: Column) -> Column:
    head = latin1(F.substring(content, 1, HEADER_BYTES))
    return printable_ratio(head) > 0.95


def is_probably_text(content: Column) -> Column:
    """The looser test used before container detection; a zero byte rules it out."""
    head = latin1(F.substring(content, 1, HEADER_BYTES))
    return (F.octet_length(content) > 0) & ~F.contains(head, F.lit("\u0000")) & (printable_ratio(head) > 0.90)


def _with_coff(files: DataFrame, content: Column) -> DataFrame:
    """Stage the executable header as columns, so that later tests do not repeat its expression."""
    staged = files.withColumn("_at", _number(_bytes(content, 0x3C, 4), 4))
    return staged.withColumn("_coff", _bytes(content, F.col("_at"), 24))


def identify(files: DataFrame, content: str = "content") -> DataFrame:
    """Add kind, media_type, architecture, is_dll, elf_class."""
    c, head = F.col(content), F.col("_head")
    staged = _with_coff(files, c).withColumns({"_head": _bytes(c, 0, 24), "_text": looks_like_text(c)})
    kind, media = F.when(F.col("_text"), "text").otherwise("unknown"), F.when(F.col("_text"), "text/plain")
    for magic, name, media_type in reversed(SIGNATURES):
        kind = F.when(head.startswith(magic), name).otherwise(kind)
        media = F.when(head.startswith(magic), media_type).otherwise(media)
    staged = staged.withColumns({"kind": kind, "media_type": media})
    pe = (F.col("kind") == "pe") & F.col("_coff").startswith("50450000")
    elf = (F.col("kind") == "elf") & (F.octet_length(c) >= 20)
    little = F.substring(head, 11, 2) == "01"
    staged = staged.withColumns({
        "_machine": F.when(pe, _number(F.substring("_coff", 9, 4), 2)).when(elf, _number(F.substring(head, 37, 4), 2, little)),
        "_flags": F.when(pe, _number(F.substring("_coff", 45, 4), 2)), "_elf": elf})
    machine = F.col("_machine")
    return staged.withColumns({
        "architecture": F.when(F.col("_elf"), _name(machine, ELF_MACHINES, 2)).otherwise(_name(machine, PE_MACHINES, 4)),
        "is_dll": F.col("_flags").bitwiseAND(F.lit(0x2000).cast("bigint")) > 0,
        "elf_class": F.when(F.col("_elf"), F.when(F.substring(head, 9, 2) == "02", "64-bit").otherwise("32-bit"))}).drop(
            "_at", "_coff", "_head", "_text", "_machine", "_flags", "_elf")


def with_overlay_offset(files: DataFrame, content: Column) -> DataFrame:
    """Add ``_overlay``: where data appended to an executable begins (the end of its last raw section), or null."""
    coff = F.col("_coff")
    ok = coff.startswith("50450000") & (F.length(coff) == 48) & (F.col("_at") > 0)
    staged = _with_coff(files, content).withColumn("_sections", F.when(ok, _number(F.substring(coff, 13, 4), 2)))
    staged = staged.withColumn("_table", F.when(F.col("_sections").between(1, 96), F.col("_at") + 24 + _number(F.substring(coff, 41, 4), 2)))
    count = F.when(F.col("_table").isNotNull(), F.col("_sections"))
    entries = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: _bytes(content, F.col("_table") + i * 40, 40))
    staged = staged.withColumn("_entries", F.filter(entries, lambda e: F.length(e) == 80))
    parsed = F.transform("_entries", lambda e: F.struct(_number(F.substring(e, 33, 8), 4).alias("size"), _number(F.substring(e, 41, 8), 4).alias("at")))
    ends = F.transform(F.filter(parsed, lambda p: (p["size"] > 0) & (p["at"] > 0)), lambda p: p["size"] + p["at"])
    staged = staged.withColumn("_end", F.array_max(ends))
    overlay = bind(F.col("_end"), lambda e: F.when((e > 0) & (e < F.octet_length(content)), e))
    return staged.withColumn("_overlay", overlay).drop("_at", "_coff", "_sections", "_table", "_entries", "_end")


def detect_container(files: DataFrame, path: str = "path_in_tree", content: str = "content") -> DataFrame:
    """Add container, container_confidence, container_reason, should_unpack."""
    c = F.col(content)
    size = F.octet_length(c)
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))

    def verdict(container: Column | str, confidence: float, reason: Column | str) -> Column:
        container = F.lit(container) if isinstance(container, str) else container
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(container.alias("container"), F.lit(confidence).alias("confidence"), reason.alias("reason"))

    files = with_overlay_offset(files, c)
    overlay = F.coalesce(F.substring(c, F.col("_overlay").cast("int") + 1, F.lit(OVERLAY_BYTES)), F.lit(b""))
    tail = F.when(size > SNIFF_BYTES, F.substring(c, F.greatest(size - TAIL_BYTES, F.lit(0)) + 1, F.lit(TAIL_BYTES))).otherwise(F.lit(b""))
    is_pe = _bytes(c, 0, 2) == "4D5A"
    windows = F.when(is_pe, latin1(F.concat(F.substring(c, 1, SNIFF_BYTES), overlay, tail)))

    def installer(text: Column) -> Column:
        found = verdict("none", 0.9, "PE with no installer payload detected")
        for marker, name in reversed(PE_MARKERS):
            found = F.when(F.contains(text, F.lit(marker)), verdict(name, 0.85, f"PE containing {marker!r}")).otherwise(found)
        return found

    def by_content(ending: Column) -> Column:
        out = F.when(is_pe, bind(windows, installer)).otherwise(verdict("none", 0.8, "no container signature"))
        for at, magic, name in reversed(CONTAINER_MAGIC):
            this = verdict(name, 0.95, f"magic at offset {at}")
            if name == "zip":
                for extension, special in ZIP_FAMILY.items():
                    this = F.when(ending == extension, verdict(special, 0.95, f"zip signature with {extension}")).otherwise(this)
            out = F.when(_bytes(c, at, len(magic) // 2) == magic, this).otherwise(out)
        for extension, name in BY_EXTENSION.items():
            out = F.when(ending == extension, verdict(name, 0.7, f"extension {extension}")).otherwise(out)
        return F.when(size < 16, verdict("none", 1.0, "too small to be a container")).otherwise(out)

    out = bind(suffix, by_content)
    # the struct is read four times: keep it a column of its own
    marked = files.withColumn("_d", out)
    return marked.withColumns({
        "container": F.col("_d.container"), "container_confidence": F.col("_d.confidence"), "container_reason": F.col("_d.reason"),
        "should_unpack": (F.col("_d.container") != "none") & (F.col("_d.confidence") >= UNPACK_CONFIDENCE)}).drop("_d", "_overlay")
