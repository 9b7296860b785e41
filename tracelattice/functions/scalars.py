"""Column functions for ids, batch names and times, and the integer arithmetic of index nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def hex_id(c: Column) -> Column:
    """Raw id bytes as lower-case hex."""
    return F.lower(F.hex(c))


def split_tokens(c: Column, delimiter: str) -> Column:
    """Pieces between delimiters; each loses one line end."""
    quoted = F.lit("\\Q" + delimiter + "\\E")
    return F.transform(F.split(c, quoted), lambda t: F.regexp_replace(t, "\n$", ""))


def strip_last(c: Column, char: str) -> Column:
    """Without one trailing ``char``."""
    return F.when(F.endswith(c, F.lit(char)), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def batch_of_object(c: Column) -> Column:
    """The batch name in ``folder/batch``."""
    return F.try_element_at(F.split(c, "/"), F.lit(2))


def batch_bounds(c: Column) -> tuple[Column, Column]:
    """Start and end seconds of a batch name ``HH-start-end``; null where the name has another form."""
    well = F.octet_length(c) - F.octet_length(F.replace(c, F.lit("-"), F.lit(""))) == 2  # no arrays: this runs for every span
    parts = F.substring_index(F.substring_index(c, "-", 2), "-", -1), F.substring_index(c, "-", -1)
    return tuple(F.when(well, x.try_cast("bigint")) for x in parts)


def seconds(ns: Column) -> Column:
    """Whole epoch seconds of a nanosecond time."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(NS)), F.lit(NS))


def floor_to(c: Column, step: int) -> Column:
    return c - F.pmod(c, F.lit(step))


def latency(start: Column, end: Column) -> Column:
    """Signed nanoseconds."""
    return end - start


def attribute(key: str, column: str = "attributes") -> Column:
    """Value of the first attribute with this key, null if there is none."""
    return F.try_element_at(F.filter(F.col(column), lambda a: a["key"] == F.lit(key)), F.lit(1))["value"]


def as_text(c: Column, kind: str) -> Column:
    """A property as text: doubles with six decimals, ids and bytes as hex, bools as words."""
    if kind == "double":
        return F.format_string("%.6f", c.cast("double"))
    return hex_id(c) if kind == "bytes" else c.cast("string")


def literal_text(value: object) -> str:
    """A literal in the form that ``as_text`` gives a property of its type."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.6f}"
    return value.hex() if isinstance(value, bytes | bytearray) else str(value)


def replace_all(c: Column, old: str, new: str) -> Column:
    """Every occurrence from left to right; an empty ``old`` changes nothing."""
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def is_spans_folder(c: Column) -> Column:
    """True for folders of spans: neither an index nor structures nor hashes of traces."""
    return ~(F.startswith(c, F.lit("index-")) | F.startswith(c, F.lit("dyntraces")) | F.startswith(c, F.lit("tracehashes")))


def index_folder(prop: Column) -> Column:
    """Folder of an attribute's index."""
    return F.concat(F.lit("index-"), replace_all(prop, ".", "-"))


def progress_text(done: float, label: str, width: int = 70) -> str:
    """One line with a bar."""
    at = int(width * done)
    return f" [{'=' * min(at, width)}{'>' * (at < width)}{' ' * max(0, width - at - 1)}] {int(done * 100)}% {label}"


# Index node arithmetic -------------------------------------------------------------------------


def parent_node(start: int, end: int, granularity: int) -> tuple[int, int]:
    """The node one level up: ``granularity`` times as wide, aligned to its own width."""
    width = (end - start) * granularity
    first = start // width * width
    return first, first + width


def child_nodes(start: int, end: int, granularity: int) -> list[tuple[int, int]]:
    width = (end - start) // granularity
    return [(s, s + width) for s in range(start, end, width)] if width else []


def nearest_node(root: tuple[int, int], granularity: int, start: int, end: int) -> tuple[int, int]:
    """The narrowest node below ``root`` that holds the whole window."""
    node = root
    while node[1] - node[0] > granularity:
        inner = [c for c in child_nodes(*node, granularity) if c[0] <= start and end <= c[1]]
        if not inner:
            break
        node = inner[0]
    return node


def time_prefixes(earliest: int, latest: int) -> list[str]:
    """Shortest list of digit prefixes of one length that covers the window at the first digit that differs."""
    a, b = str(earliest), str(latest)
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a) - 1)
    cut = 10 ** (len(a) - same - 1)
    return [str(p) for p in range(earliest // cut, latest // cut + 1)]


def effective_fpp(bits: int, hashes: int, inserted: int) -> float:
    """False positive rate of a Bloom filter that holds ``inserted`` values."""
    from math import exp

    return (1 - exp(-hashes * inserted / bits)) ** hashes


def bloom_size(n: int, fpp: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n keys at a false positive rate."""
    from math import ceil, log

    bits = max(64, ceil(-n * log(fpp) / log(2) ** 2))
    return bits, max(1, round(bits / n * log(2)))
