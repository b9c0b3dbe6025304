"""Typed values mapped to a reference list: a trie of all spellings, searched with a Levenshtein automaton."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.functions import geo, text
from slatework.session import ship, small, whole_list

# Letters that don't decompose, and their plain letters.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})
#: Spellings that a trie may hold in every task.
MOST_SPELLINGS = 2_000_000
#: Words around a value that don't tell entries apart.
CITY_NOISE = r"^(?:city|town|municipality|greater) of | (?:city|town|municipality)$|^\d+ | \d+$"
ROOF_NOISE = r"\b(?:roof|roofs|style|main|shape|shaped|type)\b"


def plain(value: str) -> str:
    """Folded text: repaired when it was UTF-8 read as Latin-1, without case, marks and punctuation, single blanks."""
    try:
        value = value.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        try:
            value = value.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    value = unicodedata.normalize("NFKD", value.casefold()).translate(PLAIN)
    value = regex.sub(r"[\p{M}\p{Cf}]", "", value)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", value).strip()


def allowed(length: int) -> int:
    """Edits allowed for a text of this length."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 8 else 3


class Trie:
    """All spellings of all entries. ``search`` gives every entry within the allowed distance.

    The automaton's states are shared by all values: a state is the band of the edit
    table around the diagonal, and a step depends only on where in the band the
    value has the letter. Steps are worked out once and looked up afterwards.
    """

    def __init__(self, paths: list[tuple[str, int]]):
        self.root: dict = {}
        self.size = 0
        for spelling, entry in paths:
            node = self.root
            for c in spelling:
                node = node.setdefault(c, {})
            node.setdefault("", set()).add(entry)
            self.size += 1
        self.automata: dict[int, tuple[list, dict, dict]] = {}  # per limit: states, steps, numbers of states

    def _step(self, k: int, state: tuple, chi: int) -> tuple | None:
        """The state after a letter that the value has at the places ``chi`` of the band; None if no match can follow."""
        row, above, before = state
        far, width = k + 1, 2 * k + 1
        new = [far] * width
        for t in range(width):
            d = row[t] + (not chi >> t & 1)
            if t + 1 < width and row[t + 1] + 1 < d:
                d = row[t + 1] + 1
            if t and new[t - 1] + 1 < d:
                d = new[t - 1] + 1
            if above is not None and 0 < t < width - 1 and chi >> (t - 1) & 1 and before >> (t + 1) & 1 and above[t] + 1 < d:
                d = above[t] + 1
            new[t] = min(d, far)
        if min(new) > k and min(row) >= k:
            return None
        return tuple(new), row, chi

    def search(self, value: str, most: int | None = None) -> dict[int, int]:
        """Entry -> least distance, for all within ``most`` edits (by length if not given).

        An edit inserts, deletes or replaces a letter or swaps two neighbours. A
        branch ends when the band is empty.
        """
        k = allowed(len(value)) if most is None else most
        n, width = len(value), (1 << 2 * k + 1) - 1
        if k not in self.automata:
            first = (tuple([k + 1] * k + list(range(k + 1))), None, 0)
            self.automata[k] = ([first], {}, {first: 0})
        states, steps, known = self.automata[k]
        places: dict[str, int] = {}
        for i, c in enumerate(value):
            places[c] = places.get(c, 0) | 1 << i
        found: dict[int, int] = {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, state = stack.pop()
            o = n - depth
            if -k <= o <= k and "" in node and (d := states[state][0][o + k]) <= k:
                for e in node[""]:
                    if d < found.get(e, k + 1):
                        found[e] = d
            if o < -k:
                continue
            shift = depth - k
            for c, child in node.items():
                if c:
                    m = places.get(c, 0)
                    chi = (m >> shift if shift > 0 else m << -shift) & width
                    to = steps.get((state, chi), 0)
                    if to == 0:
                        nxt = self._step(k, states[state], chi)
                        if nxt is not None and nxt not in known:
                            known[nxt] = len(states)
                            states.append(nxt)
                        to = steps[state, chi] = None if nxt is None else known[nxt]
                    if to is not None:
                        stack.append((child, depth + 1, to))
        return found


def city_paths(entries: list[tuple[int, str, str]]) -> list[tuple[str, int]]:
    """Spellings of (id, "Name, Country", country): with, without and before the country, with it cut short, with the district."""
    out = []
    for i, name, country in entries:
        c = plain(country or "")
        full = plain(name)
        n = plain(name.rsplit(",", 1)[0]) if "," in name else full
        out += [(full, i), (n, i)]
        if c:
            out += [(f"{n} {c}", i), (f"{c} {n}", i), (f"{n} {n} district {c}", i), (f"{n} {n} district", i)]
            out += [(f"{n} {c[:k]}", i) for k in range(2, 6) if k < len(c)]
    return list(dict.fromkeys(out))


def roof_paths(entries: list[tuple[int, str, str | None]]) -> list[tuple[str, int]]:
    """Canonical names and what they are also called; a name within a name may be called so too (half-hip)."""
    called = {i: [plain(n), *(plain(x) for x in (also or "").split(",") if plain(x))] for i, n, also in entries}
    out = [(s, i) for i, names in called.items() for s in names]
    single = {names[0]: names[1:] for names in called.values() if " " not in names[0]}
    for i, names in called.items():
        words = names[0].split()
        if len(words) > 1:
            out += [(" ".join([*words[:j], other, *words[j + 1 :]]), i) for j, w in enumerate(words) for other in single.get(w, [])]
    return list(dict.fromkeys(out))


def mapped_values(values: DataFrame, paths: list[tuple[str, int]], noise: str, places: dict[int, tuple[float, float]]) -> DataFrame:
    """(value, refs) of distinct values: all entries within the length-dependent distance, with distance and place; none if there is no entry.

    A value is read as it is and without the words that tell no entries apart; the
    least distance of an entry counts. The trie is built in each task from the spellings, which grow with the
    reference list only; a list of more than MOST_SPELLINGS is refused. Values are dealt
    to tasks by hash: a search costs far more than its bytes tell.
    """
    if len(paths) > MOST_SPELLINGS:
        raise ValueError(f"{len(paths)} spellings are too many for a trie in every task")
    spark = values.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((paths, places))
    drop = noise

    def run(batches):
        spellings, at = shared.value
        trie, strip = Trie(spellings), regex.compile(drop)
        for pdf in batches:
            refs = []
            for v in pdf["value"]:
                p = plain(v)
                bare = " ".join(strip.sub(" ", p).split())
                hits = [trie.search(x) for x in dict.fromkeys((p, bare)) if x]
                least = {e: min(h[e] for h in hits if e in h) for h in hits for e in h}
                refs.append([{"ref": e, "edits": d, "lat": at.get(e, (None, None))[0], "lon": at.get(e, (None, None))[1]} for e, d in least.items()])
            yield pd.DataFrame({"value": pdf["value"], "refs": refs})

    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # By another expression than the value: the exchange of the distinct would be taken for this one, and coalesced.
    dealt = values.select("value").where("value is not null").distinct().repartition(wide, F.xxhash64("value"))
    return dealt.mapInPandas(run, "value string, refs array<struct<ref:long,edits:int,lat:double,lon:double>>")


#: Metres from an entry's place within which a row is taken to lie there.
HOME_M = 100_000.0


def to_reference(rows: DataFrame, reference: DataFrame, paths: list[tuple[str, int]], noise: str, ref_id: str, ref_name: str, places: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """(id, value, ref_id, exact) of rows (id, value, lat, lon): the entry meant, -1 if none.

    A value that is an entry character for character is ``exact``. Of the entries
    within the allowed distance those at whose place the row lies go first (a slip may
    lead to the name of another place), then the least distance, then the nearest place,
    without a location (of the row or the entries) the first by id. Null values give no row. Values are
    searched once each, however many rows hold them.
    """
    r = reference.select(F.col(ref_id).cast("long").alias("ref"), F.col(ref_name).alias("name"))
    r = r.groupBy("name").agg(F.min("ref").alias("ref"))
    exact = rows.select("id", "value", "lat", "lon").where("value is not null").join(small(r), F.col("value") == F.col("name"), "left")
    hit = exact.where("ref is not null").select("id", "value", F.col("ref").alias("ref_id"), F.lit(True).alias("exact"))
    rest = exact.where("ref is null").select("id", "value", "lat", "lon")
    found = rest.join(mapped_values(rest.select("value"), paths, noise, places or {}), "value", "left")
    here = geo.usable_location(F.col("lat"), F.col("lon"))
    away = lambda e: F.coalesce(F.when(here, geo.great_circle_m(F.col("lat"), F.col("lon"), e.lat, e.lon)), F.lit(1e12))
    weighed = F.array_min(F.transform("refs", lambda e: F.struct((away(e) > HOME_M).alias("far"), e.edits.alias("edits"), away(e).alias("d"), e.ref.alias("ref"))))["ref"]
    best = F.when(F.size("refs") > 1, weighed).otherwise(F.try_element_at("refs", F.lit(1))["ref"])
    return hit.unionByName(found.select("id", "value", F.coalesce(best, F.lit(-1)).cast("long").alias("ref_id"), F.lit(False).alias("exact")))


def _city_list(reference: DataFrame) -> tuple[list[tuple[str, int]], dict[int, tuple[float, float]]]:
    """Spellings and places of a reference list (city_id, city_name, country, latitude, longitude)."""
    named = whole_list(reference.where("city_name is not null"), MOST_SPELLINGS)  # a reference list
    places = {r["city_id"]: (r["latitude"], r["longitude"]) for r in named if r["latitude"] is not None and r["longitude"] is not None}
    return city_paths([(r["city_id"], r["city_name"], r["country"]) for r in named]), places


def cities(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Typed cities of (id, value, lat, lon) mapped to (city_id, city_name, country, latitude, longitude)."""
    paths, places = _city_list(reference)
    return to_reference(rows.where(~text.is_blank(F.col("value"))), reference, paths, CITY_NOISE, "city_id", "city_name", places)


def candidates(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, refs) of distinct typed cities: all entries within the allowed distance."""
    paths, places = _city_list(reference)
    return mapped_values(values, paths, CITY_NOISE, places)


def roofshapes(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Typed roof shapes mapped to (shape_id, roofshape, also_called); values that stand for a missing one are left out."""
    from slatework.functions import entries as e

    named = [(r["shape_id"], r["roofshape"], r["also_called"]) for r in whole_list(reference.where("roofshape is not null"), MOST_SPELLINGS)]  # a reference list
    return to_reference(rows.where(~e.says_nothing(F.col("value"))), reference, roof_paths(named), ROOF_NOISE, "shape_id", "roofshape")
