"""Small column functions: identifiers, cleaning, ratios, labels, dates, URLs.

Unless said otherwise a null input gives null, and nothing raises under ANSI mode.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: estimates at or below are codes for missing.
SENTINEL_FLOOR = -100_000_000


def zero_filled(c: Column, width: int) -> Column:
    """Left-padded with zeros; longer text stays as it is."""
    c = c.cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def geoid(*parts: tuple[Column, int]) -> Column:
    """Components, each zero-filled to its width, as one identifier."""
    return F.concat(*(zero_filled(c, w) for c, w in parts))


def numeric(c: Column) -> Column:
    return c.try_cast("double")


def without_sentinel(c: Column, floor: float = SENTINEL_FLOOR) -> Column:
    return F.when(c > floor, c)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is null or zero."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def row_sum(columns: Iterable[Column], null_if_all_null: bool) -> Column:
    """Sum over columns with null as 0; if asked, null where all are null."""
    columns = list(columns)
    total = sum((F.coalesce(c, F.lit(0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0)))
    return F.when(F.coalesce(*columns).isNotNull(), total) if null_if_all_null else total


def diversity(groups: list[Column], total: Column) -> Column:
    """1 minus the sum of squared shares; null if a group or the total is null or the total 0."""
    shares = [safe_ratio(g, total) for g in groups]
    return F.lit(1.0) - sum((s * s for s in shares[1:]), shares[0] * shares[0])


def text_or_empty(columns: list[str], name: str) -> Column:
    """lower-cased text of a column, empty where null or where the table hasn't the column."""
    return F.coalesce(F.lower(F.col(f"`{name}`").cast("string")), F.lit("")) if name in columns else F.lit("")


def plain_ascii(text: str) -> str:
    """Case folded, compatibility characters taken apart, and of these what is ASCII: é is e, ß ss, ﬁ fi; letters without such a form go."""
    return unicodedata.normalize("NFKD", text.casefold()).encode("ascii", "ignore").decode()


@F.arrow_udf(T.StringType())
def folded(text: pa.Array) -> pa.Array:
    """plain_ascii of every text of a batch, each different one worked on once; ASCII texts are only lower-cased."""
    words = pc.dictionary_encode(text.cast(pa.large_string()))
    once = words.dictionary
    rest = pc.invert(pc.string_is_ascii(once))
    made = pc.replace_with_mask(pc.ascii_lower(once), rest, pa.array([plain_ascii(x) for x in once.filter(rest).to_pylist()], pa.large_string()))
    return made.take(words.indices).cast(pa.string())


def normal_label(c: Column) -> Column:
    """Case folded, without accents and other marks in any script, each run of other characters a blank, trimmed; `nan` is empty."""
    label = F.trim(F.regexp_replace(folded(c.cast("string")), "[^a-z0-9]+", " "))
    return F.when(label == "nan", "").otherwise(label)


def has_tokens(label: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """A normal label has all of the first tokens and none of the second."""
    words = F.split(label, " ")
    out = F.lit(True)
    for t in include:
        out = out & F.array_contains(words, t)
    for t in exclude:
        out = out & ~F.array_contains(words, t)
    return F.coalesce(out, F.lit(False))


def slug(c: Column, joiner: str = "_") -> Column:
    """A label with its words joined, fit for file and table names."""
    return F.replace(normal_label(c), F.lit(" "), F.lit(joiner))


def first_filled(*columns: Column) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def after(c: Column, cutoff: str) -> Column:
    """At or after the cutoff; false for null."""
    return F.coalesce(c >= F.lit(cutoff).cast("timestamp"), F.lit(False))


def timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c)


def date_of_parts(d: Column) -> Column:
    """A date from struct<year, month, day>; null if a part is missing."""
    return F.when(d.year.isNotNull() & d.month.isNotNull() & d.day.isNotNull(), F.make_date(d.year, d.month, d.day))


def quarter_columns(period: Column) -> dict[str, Column]:
    """quarter, quarter_key, quarter_label, quarter_start, quarter_end and is_year_end of a date."""
    start = F.trunc(period, "quarter")
    q, y = F.quarter(period).cast("string"), F.year(period).cast("string")
    return {
        "quarter": F.concat(y, F.lit("Q"), q),
        "quarter_key": F.concat(y, F.lit("-Q"), q),
        "quarter_label": F.concat(F.lit("Q"), q, F.lit(" "), y),
        "quarter_start": start,
        "quarter_end": F.last_day(F.add_months(start, 2)),
        "is_year_end": F.quarter(period) == 4,
    }


def resolve_href(base: Column, href: Column) -> Column:
    """A link in view of its document's: absolute as it is, else relative to the host (with a leading slash) or to the document's folder.

    Segments . and .. of the path are resolved, however many; a .. above the top goes. The host is never one of
    them. A query or fragment of the link stays. Null if either is null.
    """
    absolute = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.substr(base, F.length(root) + 1), "^([^?#]*/)", 1)
    path, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    parts = F.slice(F.split(joined, "/"), 2, F.length(joined) + 1)
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(none)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    last = F.element_at(parts, -1)
    end = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))  # these name a folder
    done = F.aggregate(parts, none, step)
    whole = F.concat(root, F.lit("/"), F.array_join(done, "/"), F.when(F.size(done) > 0, end).otherwise(F.lit("")), rest)
    same = F.regexp_extract(base, "^([^#]*)", 1)
    alone = F.when(F.startswith(href, F.lit("#")), F.concat(same, href)).when(F.startswith(href, F.lit("?")), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), href)).when(href == "", same)
    return F.when(absolute, href).otherwise(F.coalesce(alone, whole))


def without_query(c: Column, host: str) -> Column:
    """A link to this host without its query; other links unchanged."""
    return F.when(F.regexp_extract(c, "^[a-z0-9+.-]+://([^/?#]*)", 1) == host, F.regexp_replace(c, r"\?.*$", "")).otherwise(c)


def query_value(c: Column, key: str) -> Column:
    """The value of a key in a URL's query, null without."""
    return F.nullif(F.regexp_extract(c, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


def size_label(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB."""
    out, n = None, n.cast("double")
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        text = F.format_string("%.1f " + unit, n / float(1024**i))
        out = F.when(n < 1024.0 ** (i + 1), text) if out is None else out.when(n < 1024.0 ** (i + 1), text) if i < 4 else out.otherwise(text)
    return F.when(n.isNotNull(), out)


def equal_area_radius(area: Column) -> Column:
    """Radius of the circle of this area, rounded up."""
    return F.ceil(F.sqrt(area / F.pi()))


def allowed_pixel(radius: Column, pixel: Column, allowed: list[float] = (0.1, 0.25, 0.5, 1.0)) -> Column:
    """The smallest allowed pixel size not below the asked one with radius <= 1000 pixels; the asked one for a radius of 100 or less; null if none."""
    fit = F.filter(F.array(*map(F.lit, sorted(allowed))), lambda p: (p >= pixel) & (radius <= p * 1000))
    return F.when(radius <= 100, pixel.cast("double")).otherwise(F.array_min(fit))


def resolution_cm(gsd: Column, source: Column, fallback: dict[str, float]) -> Column:
    """Ground sample distance in cm, else the source's usual one, else null."""
    return F.coalesce(gsd.try_cast("double") * 100, lookup(source, fallback))


def lookup(c: Column, table: dict, default=None) -> Column:
    """A constant table's value for a column."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def elevation(height: Column, floors: Column, storey: float = 3.2, least: float = 1.0) -> Column:
    """Height, else floors times a storey, else the least; never below it."""
    return F.greatest(F.coalesce(height, floors * storey, F.lit(least)), F.lit(least))


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value of any type with fields and map keys in order, NaN and infinities null, bytes as hexadecimal digits."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda k: F.struct(k.cast("string").alias("key"), canonical(F.element_at(c, k), kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), entry))
    if isinstance(kind, T.StructType):
        fields = [canonical(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    return c


def canonical_json(values: dict[str, Column], of: DataFrame | None = None) -> Column:
    """A JSON object with sorted keys; nulls stay as fields, times have no zone.

    of: the table the columns are of; then what is nested is sorted too, and NaN and infinities are null at any
    depth. Without it only the object's own keys are sorted.
    """
    names = sorted(values)
    if of is not None:
        kinds = of.select(*(values[n].alias(n) for n in names)).schema
        values = {n: canonical(values[n], kinds[n].dataType) for n in names}
    return F.to_json(F.struct(*(values[n].alias(n) for n in names)), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def finite(c: Column) -> Column:
    """A number, or null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def coerced_list(c: Column) -> Column:
    """A text as array of texts: a JSON array's elements, a blank text none, any other text alone; null stays null."""
    read = F.from_json(c, "array<string>")
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).when(F.startswith(F.trim(c), F.lit("[")) & read.isNotNull(), read).when(c.isNotNull(), F.array(c))


def coerced_map(c: Column) -> Column:
    """A text as map of texts: a JSON object's fields, else empty; null stays null."""
    read = F.from_json(c, "map<string,string>")
    return F.when(c.isNotNull(), F.coalesce(F.when(F.startswith(F.trim(c), F.lit("{")), read), F.create_map().cast("map<string,string>")))


def whole_number(c: Column) -> Column:
    """A text or number as long if it has no fraction, else null."""
    x = c.try_cast("double")
    return F.when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.cast("long"))


def resolution_text(metres: Column) -> Column:
    """A resolution as text: below a metre in whole centimetres, else in metres with up to two decimals; `unknown` for null, zero and less."""
    cm = F.format_string("%d cm", F.round(metres * 100).cast("long"))
    m = F.concat(F.regexp_replace(F.format_string("%.2f", metres), r"\.?0+$", ""), F.lit(" m"))
    return F.when(metres > 0, F.when(F.round(metres * 100) < 100, cm).otherwise(m)).otherwise("unknown")
