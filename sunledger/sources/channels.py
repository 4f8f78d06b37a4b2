"""Headers and column names of logger files: channel blocks, labels, kinds and their limits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger.plans.spec import SolarAngles, Spec

#: Statistics in column names.
STATISTICS = ("Avg", "SD", "Min", "Max", "Gust", "GustDir", "Sum", "Total", "NotUsed")
PLOT_STATISTICS = ("Avg", "Average", "SD", "StdDev", "Min", "Max", "Gust", "Sum", "Total", "NotUsed")
LEVELS = ("", "Avg", "Min", "Max", "Gust")


def _key(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), ":$", "")


def _filled(x: Column) -> Column:
    """Empty for what is absent or reads nan."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("nan")), F.lit(""))


def site_fields(header: DataFrame) -> DataFrame:
    """file and fields: a map of header labels, the last of a repeated one."""
    rows = header.filter("key IS NOT NULL").groupBy("file", _key(F.col("key")).alias("label")).agg(F.max_by(F.trim("value"), "pos").alias("value"))
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("fields"))


def channel_blocks(header: DataFrame) -> DataFrame:
    """file, block_no, channel, fields: every Channel key opens a block; in it the first value of a label counts."""
    w = Window.partitionBy("file").orderBy("pos")
    rows = header.filter("key IS NOT NULL").withColumn("label", _key(F.col("key")))
    rows = rows.withColumn("block_no", F.sum((F.col("label") == "Channel").cast("int")).over(w)).filter("block_no > 0")
    first = rows.groupBy("file", "block_no", "label").agg(F.min_by(F.trim("value"), "pos").alias("value"))
    blocks = first.groupBy("file", "block_no").agg(F.max(F.when(F.col("label") == "Channel", F.col("value"))).alias("channel"), F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("fields"))
    return blocks.select("file", "block_no", F.col("channel").try_cast("int").alias("channel"), "fields")


def _field(label: str) -> Column:
    return _filled(F.element_at("fields", label))


def channel_names(blocks: DataFrame) -> DataFrame:
    """file, channel, name: Ch<n>_<sensor>_[Measurand_]<Units> of the channel's last block."""
    sensor = F.coalesce(*[F.nullif(_field(x), F.lit("")) for x in ("Description", "Sensor Type", "Type")])
    part = lambda x: F.nullif(F.regexp_replace(x, r"\s+", "_"), F.lit(""))
    name = F.concat_ws("_", F.concat(F.lit("Ch"), F.col("channel").cast("string")), part(sensor), part(_field("Measurand")), part(_field("Units")))
    return blocks.groupBy("file", "channel").agg(F.max_by(name, "block_no").alias("name"))


def rename_channels(columns: list[str], names: dict[int, str], drop_unused: bool = True) -> dict[str, str]:
    """Old to new column names. Decided from the schema: the statistic is the last known token of a name."""
    found: list[tuple[str, int | None, str]] = []
    for c in columns:
        m = re.match(r"Ch(\d+)_", c)
        stats = [t for t in c.split("_")[1:] if t in STATISTICS] if m else []
        if drop_unused and stats[-1:] == ["NotUsed"]:
            continue
        found.append((c, int(m[1]) if m and int(m[1]) in names else None, stats[-1] if stats else ""))
    per = {n: sum(1 for _, k, _ in found if k == n) for _, n, _ in found if n is not None}
    out: dict[str, str] = {}
    for c, n, stat in found:
        new = c
        if n is not None:
            head, _, rest = names[n].partition("_")
            new = f"{head}_{stat}_{rest}" if per[n] > 1 and stat else names[n]
        if new in out.values():
            raise ValueError(f"two columns would be named {new!r}")
        out[c] = new
    return out


def signal_groups(columns: list[str], statistics: tuple[str, ...] = ("Avg", "Min", "Max", "SD")) -> dict[str, list[str]]:
    """Columns of one signal by trailing statistic; one without is a group of its own."""
    out: dict[str, list[str]] = {}
    for c in columns:
        head, _, tail = c.rpartition("_")
        out.setdefault(head if head and tail in statistics else c, []).append(c)
    return out


def grouped_signals(names: DataFrame, statistics: tuple[str, ...] = ("Avg", "Min", "Max", "SD")) -> DataFrame:
    """signal_groups of many files at once. names: file, pos, name. file, signal, columns (by pos; a file's columns are few)."""
    tail = F.regexp_extract("name", r"^.+_([^_]*)$", 1)
    signal = F.when(tail.isin(*statistics), F.regexp_extract("name", r"^(.+)_[^_]*$", 1)).otherwise(F.col("name"))
    groups = names.groupBy("file", signal.alias("signal")).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("all"))
    return groups.select("file", "signal", F.transform("all", lambda x: x["name"]).alias("columns"))


def spec_rows(names: DataFrame, kinds: DataFrame, sunlit: bool = False, extremes: bool = True) -> DataFrame:
    """spec_for of many files at once, as rows: file, check, signal, lo, hi, window_us.

    names: file, name of each column; kinds: file, channel, kind. Columns meet their kind by file and channel; the table of
    kinds is a literal of the plan. Of two columns of one channel and statistic the last by name counts.
    """
    listed = names.withColumn("channel", F.regexp_extract("name", r"^Ch(\d+)_([^_]+)", 1).try_cast("int")).filter("channel IS NOT NULL")
    token = F.regexp_extract("name", r"^Ch(\d+)_([^_]+)", 2)
    listed = listed.withColumn("stat", F.when(token.isin(*STATISTICS), token).otherwise(""))
    per = listed.groupBy("file", "channel", "stat").agg(F.max("name").alias("name")).groupBy("file", "channel").agg(F.map_from_entries(F.collect_list(F.struct("stat", "name"))).alias("of"))
    said = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.struct(F.lit(float(v.lo)).alias("lo"), F.lit(float(v.hi)).alias("hi"), F.lit(v.dynamic).alias("dynamic"), F.lit("range" in v.sunlit).alias("sunlit_range"), F.lit("stall" in v.sunlit).alias("sunlit_stall"), F.lit(v.extremes).alias("extremes"), F.lit(int(v.stall_hours * 3_600_000_000)).alias("window")))])
    rows = per.join(kinds, ["file", "channel"]).withColumn("k", F.try_element_at(said, F.col("kind"))).filter("k IS NOT NULL")
    of, k = lambda s: F.try_element_at(F.col("of"), F.lit(s)), F.col("k")
    none, no_window = F.lit(None).cast("double"), F.lit(None).cast("long")
    one = lambda check, signal, lo=none, hi=none, window=no_window: F.struct(F.lit(check).alias("check"), signal.alias("signal"), lo.alias("lo"), hi.alias("hi"), window.alias("window_us"))
    pair = lambda a, b: F.concat(of(a), F.lit(" vs "), of(b))
    wide = F.lit(extremes) & k["extremes"] & ~(F.map_contains_key("of", "Sum") | F.map_contains_key("of", "Total"))
    ranged = k["sunlit_range"] == F.lit(sunlit)
    out = [F.when(ranged & (wide if s in ("Min", "Max") else F.lit(True)) & of(s).isNotNull(), one("range", of(s), k["lo"], k["hi"])) for s in LEVELS]
    out.append(F.when(ranged & of("SD").isNotNull(), one("range", of("SD"), F.lit(0.0), k["hi"] - k["lo"])))
    primary = F.coalesce(of("Avg"), of(""))
    out.append(F.when(k["dynamic"] & primary.isNotNull() & (k["sunlit_stall"] == F.lit(sunlit)), one("stall", primary, window=k["window"])))
    if not sunlit:
        whole = k["extremes"] & pair("Min", "Avg").isNotNull() & pair("Avg", "Max").isNotNull()
        out += [F.when(whole, one("lesser", pair("Min", "Avg"))), F.when(whole, one("lesser", pair("Avg", "Max"))), F.when(pair("Gust", "Max").isNotNull(), one("lesser", pair("Gust", "Max")))]
    return rows.select("file", F.inline(F.array_compact(F.array(*out))))


def channel_columns(columns: list[str]) -> dict[int, dict[str, str]]:
    """channel -> statistic -> column; the statistic is the token right after the channel, else empty. The last column wins."""
    out: dict[int, dict[str, str]] = {}
    for c in columns:
        if m := re.match(r"Ch(\d+)_([^_]+)", c):
            out.setdefault(int(m[1]), {})[m[2] if m[2] in STATISTICS else ""] = c
    return out


def column_grammar(names: DataFrame) -> DataFrame:
    """names (column name) with channel, statistic after the channel, and the last statistic."""
    tokens = F.split(F.regexp_replace("name", r"^Ch\d+_", ""), "_")
    known = lambda t: t.isin(*STATISTICS)
    after = F.regexp_extract("name", r"^Ch\d+_([^_]+)", 1)
    return names.withColumns({
        "channel": F.regexp_extract("name", r"^Ch(\d+)_", 1).try_cast("int"),
        "next_statistic": F.when(known(after), after).otherwise(""),
        "last_statistic": F.when(F.col("name").rlike(r"^Ch\d+_"), F.coalesce(F.try_element_at(F.filter(tokens, known), F.lit(-1)), F.lit(""))).otherwise(""),
    })


@dataclass(frozen=True)
class Kind:
    lo: float
    hi: float
    dynamic: bool = False
    stall_hours: float = 0.5
    sunlit: tuple[str, ...] = ()
    extremes: bool = True


#: Limits of each kind of measurement, and how it behaves.
KINDS = {
    "irradiance": Kind(-5, 1200, True, sunlit=("stall",)),
    "reflected irradiance": Kind(-5, 500, True, sunlit=("stall",)),
    "direct irradiance": Kind(-5, 1400, True, sunlit=("stall",)),
    "albedo": Kind(0, 1, True, sunlit=("range", "stall")),
    "soiling ratio": Kind(0, 2),
    "soiling": Kind(0, 100),
    "insolation": Kind(0, 15),
    "temperature": Kind(-40, 70, True),
    "instrument temperature": Kind(-40, 70, True, 4),
    "relative humidity": Kind(0, 100, True, 4),
    "barometric pressure": Kind(800, 1200, True, 1),
    "wind speed": Kind(0, 50, True, 2),
    "wind direction": Kind(0, 360, True, 2, extremes=False),
    "level tilt": Kind(0, 0.5),
    "array tilt": Kind(0, 75),
    "axis tilt": Kind(-90, 90),
    "downward tilt": Kind(105, 182),
    "solar zenith": Kind(0, 180, True),
    "solar elevation": Kind(-90, 90, True),
    "solar azimuth": Kind(0, 360, True),
    "monitored voltage": Kind(-0.5, 30),
    "open-circuit voltage": Kind(0, 100),
    "short-circuit current": Kind(0, 15, True, sunlit=("stall",)),
    "fan speed": Kind(0, 12000, True),
    "heater current": Kind(0, 500),
    "precipitation": Kind(0, 1000, extremes=False),
    "rainfall intensity": Kind(0, 300),
}
ANGLE, IRRADIANCE, CELSIUS = ("deg", "degrees"), ("w/m^2", "w/sqm"), ("deg_c",)
NO_UNIT, BELOW = ("", "na"), ("rhi", "rpoa")
#: The first rule whose units and words all fit names the kind; several words in one place are alternatives.
RULES: tuple[tuple[str, tuple[str, ...], tuple[tuple[str, ...], ...]], ...] = (
    ("solar zenith", ANGLE, (("zenith",),)),
    ("solar elevation", ANGLE, (("elevation angle",),)),
    ("solar azimuth", ANGLE, (("azimuth",),)),
    ("reflected irradiance", IRRADIANCE, (BELOW,)),
    ("direct irradiance", IRRADIANCE, (("dni",),)),
    ("irradiance", IRRADIANCE, ()),
    ("axis tilt", ANGLE, (("tilt x", "tilt y"),)),
    ("downward tilt", ANGLE, (("tilt",), BELOW)),
    ("level tilt", ANGLE, (("tilt",), ("ghi",))),
    ("array tilt", ANGLE, (("tilt",),)),
    ("wind direction", ANGLE, (("vane", "wind direction"),)),
    ("wind speed", ("m/s",), ()),
    ("instrument temperature", CELSIUS, (("body temp", "instrument temperature", "internal temp"),)),
    ("temperature", CELSIUS, ()),
    ("barometric pressure", ("hpa", "mbar"), ()),
    ("soiling", ("%",), (("soiling",),)),
    ("relative humidity", ("%",), ()),
    ("rainfall intensity", ("mm/hour",), ()),
    ("precipitation", ("mm",), ()),
    ("insolation", ("kwh/m^2",), ()),
    ("fan speed", ("rpm",), ()),
    ("heater current", ("ma",), ()),
    ("monitored voltage", ("v",), (("grid monitor",),)),
    ("open-circuit voltage", ("v",), (("voc",),)),
    ("short-circuit current", ("a",), (("isc",),)),
    ("albedo", NO_UNIT, (("albedo",),)),
    ("soiling ratio", NO_UNIT, (("soiling",),)),
)


def kind_of(units: Column, text: Column, rules=RULES) -> Column:
    """Name of the first rule that fits lower-cased units and text, or NULL: one expression, no join."""
    out = None
    for kind, in_units, words in rules:
        fits = units.isin(*in_units) if in_units else F.lit(True)
        for alternatives in words:
            one = F.lit(False)
            for word in alternatives:
                one = one | text.contains(word)
            fits = fits & one
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


class RuleBook:
    """Rules (as RULES) behind one automaton: a text is read once for all words of all rules, and the first rule that fits is looked up.

    A rule fits if its units hold the unit (or it has none) and each of its groups has a word in the text. What decides is
    counted from the words found, so the work of a text grows with its length and its words, not with the number of rules.
    """

    def __init__(self, rules) -> None:
        self.kinds = [kind for kind, _, _ in rules]
        self.units = [frozenset(units) for _, units, _ in rules]
        self.groups = [len(words) for _, _, words in rules]
        self.wordless: dict[str | None, int] = {}  # unit, or None for any: first rule that asks for no word
        uses: dict[str, list[tuple[int, int]]] = {}
        for nr, (_, units, words) in enumerate(rules):
            for group, alternatives in enumerate(words):
                for word in set(alternatives):
                    uses.setdefault(word, []).append((nr, group))
            if not words:
                for unit in units or (None,):
                    self.wordless.setdefault(unit, nr)
        self.always = uses.pop("", [])  # the empty word is in every text
        self.automaton = ahocorasick.Automaton()
        for word, where in uses.items():
            self.automaton.add_word(word, where)
        if uses:
            self.automaton.make_automaton()
        self.has_words = bool(uses)

    def first(self, unit: str | None, text: str | None) -> str | None:
        if unit is None or text is None:
            return None
        met: dict[int, set[int]] = {}
        found = {id(where): where for _, where in self.automaton.iter(text)}.values() if self.has_words else ()
        for where in (*found, self.always):
            for nr, group in where:
                met.setdefault(nr, set()).add(group)
        fits = [nr for nr, groups in met.items() if len(groups) == self.groups[nr] and (not self.units[nr] or unit in self.units[nr])]
        fits += [self.wordless[u] for u in (unit, None) if u in self.wordless]
        return self.kinds[min(fits)] if fits else None


def kind_by_rules(units: Column, text: Column, rules=RULES) -> Column:
    """kind_of for any number of rules: an Arrow batch at a time through one automaton, so the plan does not grow with the rules.

    The rules go to each task with the function; NULL units or texts have no kind.
    """

    @F.pandas_udf("string")
    def first(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        book = RuleBook(rules)
        for unit, words in batches:
            known: dict[tuple, str | None] = {}  # a batch's channels repeat
            yield pd.Series([known[k] if k in known else known.setdefault(k, book.first(*k)) for k in zip(unit, words, strict=True)], dtype="object")

    return first(units, text)


def channel_kinds(blocks: DataFrame, rules=RULES, as_data: bool = False) -> DataFrame:
    """file, channel, kind of each channel's last block; what no rule fits has kind NULL. as_data: rules go through one automaton (see kind_by_rules)."""
    units, text = F.lower(_field("Units")), F.lower(F.concat_ws(" ", _field("Description"), _field("Measurand")))
    last = blocks.groupBy("file", "channel").agg(F.max_by(F.struct(units.alias("units"), text.alias("text")), "block_no").alias("last"))
    kind = kind_by_rules if as_data else kind_of
    return last.select("file", "channel", F.nullif(F.coalesce(kind(F.col("last.units"), F.col("last.text"), rules), F.lit("")), F.lit("")).alias("kind"))


def channels(columns: list[str], blocks: DataFrame) -> DataFrame:
    """A row for each channel with columns: channel, description, measurand, units, statistics, kind, lo, hi, dynamic."""
    spark = blocks.sparkSession
    stats = [(n, " ".join(sorted(k for k in s if k))) for n, s in sorted(channel_columns(columns).items())]
    listed = spark.createDataFrame(stats, "channel int, statistics string")
    last = blocks.groupBy("file", "channel").agg(F.max_by("fields", "block_no").alias("fields"))
    kinds = spark.createDataFrame([(k, float(v.lo), float(v.hi), v.dynamic) for k, v in KINDS.items()], "kind string, lo double, hi double, dynamic boolean")
    out = listed.join(last, "channel", "left").join(channel_kinds(blocks), ["file", "channel"], "left").join(F.broadcast(kinds), "kind", "left")
    return out.select("file", "channel", _field("Description").alias("description"), _field("Measurand").alias("measurand"), _field("Units").alias("units"), "statistics", F.coalesce("kind", F.lit("")).alias("kind"), "lo", "hi", F.coalesce("dynamic", F.lit(False)).alias("dynamic"))


def unclassified(listed: DataFrame) -> DataFrame:
    return listed.filter("kind = ''")


def spec_for(columns: list[str], kinds: dict[int, str], sunlit: bool = False, extremes: bool = True, solar: SolarAngles | None = None) -> Spec:
    """What a file's own header and columns say it must keep to. sunlit: only the checks meant for daylight, else the others."""
    ranges: dict[str, tuple[float, float]] = {}
    dynamic: list[str] = []
    windows: dict[str, int] = {}
    lesser: list[tuple[str, str]] = []
    for channel, stats in channel_columns(columns).items():
        kind = KINDS.get(kinds.get(channel, ""))
        if kind is None:
            continue
        wide = extremes and kind.extremes and not {"Sum", "Total"} & set(stats)
        if ("range" in kind.sunlit) == sunlit:
            for stat, column in stats.items():
                if stat in LEVELS and (wide or stat not in ("Min", "Max")):
                    ranges[column] = (kind.lo, kind.hi)
                elif stat == "SD":
                    ranges[column] = (0, kind.hi - kind.lo)
        primary = stats.get("Avg", stats.get(""))
        if kind.dynamic and primary and ("stall" in kind.sunlit) == sunlit:
            dynamic.append(primary)
            windows[primary] = int(kind.stall_hours * 3_600_000_000)
        if not sunlit:
            if {"Min", "Avg", "Max"} <= set(stats) and kind.extremes:
                lesser += [(stats["Min"], stats["Avg"]), (stats["Avg"], stats["Max"])]
            if {"Gust", "Max"} <= set(stats):
                lesser.append((stats["Gust"], stats["Max"]))
    return Spec(ranges=ranges, dynamic=tuple(dynamic), stall_windows=windows, lesser=tuple(lesser), gaps=not sunlit, solar=None if sunlit else solar)


def solar_angles(columns: list[str], kinds: dict[int, str], latitude: float | None, longitude: float | None) -> SolarAngles | None:
    """Recorded angles of the first channel of each kind, at the header's position; stamps are UTC and unrefracted."""
    found: dict[str, str] = {}
    for channel, stats in channel_columns(columns).items():
        kind = kinds.get(channel, "")
        if kind.startswith("solar ") and (primary := stats.get("Avg", stats.get(""))):
            found.setdefault(kind.removeprefix("solar "), primary)
    if not found or latitude is None or longitude is None:
        return None
    return SolarAngles(latitude, longitude, tolerance=1.0, utc_offset_us=0, refract=False, **found)


def site_coordinates(fields: dict[str, str]) -> tuple[float, float]:
    """Latitude and longitude of a header, however its labels are written."""
    clean = {re.sub(r":$", "", str(k).strip()).replace("_", " ").lower(): v for k, v in fields.items()}
    out = []
    for name, limit in (("latitude", 90.0), ("longitude", 180.0)):
        raw = clean.get(name, clean.get(f"site {name}"))
        if raw is None:
            raise KeyError(f"the header has no {name}")
        try:
            value = float(raw)
        except ValueError:
            value = float("nan")
        if not abs(value) <= limit:
            raise ValueError(f"{name} is no position: {raw!r}")
        out.append(value)
    return out[0], out[1]


def site_positions(sites: DataFrame) -> DataFrame:
    """sites (with fields, as of site_fields) with latitude and longitude, as site_coordinates reads them; a header without a position is an error."""

    def one(name: str, limit: float) -> Column:
        label = lambda e: F.lower(F.replace(F.regexp_replace(F.trim(e["key"]), ":$", ""), F.lit("_"), F.lit(" ")))
        of = lambda label_is: F.get(F.reverse(F.filter(F.map_entries("fields"), lambda e: label(e) == label_is)), 0)["value"]
        raw = F.coalesce(of(name), of(f"site {name}"))
        value = raw.try_cast("double")
        wrong = F.concat(F.lit(f"{name} is no position: "), raw)
        return F.when(F.abs(value) <= limit, value).otherwise(F.raise_error(F.coalesce(wrong, F.lit(f"the header has no {name}"))).cast("double")).alias(name)

    return sites.select("*", one("latitude", 90.0), one("longitude", 180.0))


def choose_statistic(statistics: Column, named: str | None = None) -> Column:
    """The one of an array of statistics ('' for none) that stands for a signal, or NULL.

    Named: that one, or the plain one of a signal without statistics. Else the mean, the plain one, or the first.
    """
    there = lambda s: F.when(F.array_contains(statistics, s), s)
    if named is not None:
        return F.coalesce(there(named), F.when(F.size(statistics) == 1, there("")))
    return F.coalesce(there("Avg"), there("Average"), there(""), F.get(statistics, 0))


def chart_data(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Readings ready to draw: signal, statistic, panel (value or spread), draw_order, ts, value; text columns are left out."""
    from sunledger.frame import long

    kinds = dict(frame.dtypes)
    numeric = [c for c in columns if kinds.get(c) in ("double", "float", "int", "bigint")]
    parts = {}
    for c in numeric:
        m = re.match(r"^(Ch\d+)_([^_]+)(.*)$", c)
        if m and m[2] in PLOT_STATISTICS:
            parts[c] = (m[1] + m[3], m[2])
        else:
            head, _, tail = c.rpartition("_")
            parts[c] = (head, tail) if head and tail in PLOT_STATISTICS else (c, "")
    spread = {"SD", "StdDev"}
    rows = long(frame, numeric, base={c: p[0] for c, p in parts.items()}, statistic={c: p[1] for c, p in parts.items()}, panel={c: "spread" if p[1] in spread else "value" for c, p in parts.items()}, draw_order={c: i for i, c in enumerate(parts)})
    return rows.select("series_id", F.col("base").alias("signal"), "statistic", "panel", "draw_order", "ts", F.col("value_num").alias("value"))
