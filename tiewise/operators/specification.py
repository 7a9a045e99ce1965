"""Model specifications: which effects of which variable, with which parameters, and statistics of their products.

A specification is a list of rows and all operations return a new one. Which effects a data set offers follows
from its kinds of variables: an effect needs another network, a covariate, categories, a dyadic covariate or a
behaviour if its expression names one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tiewise.operators import effects as catalogue
from tiewise.plans.features import TOKEN, Effect

TYPES = ("eval", "endow", "creation", "rate", "gmm")
#: Model and behaviour model kinds, by number: fixed names.
MODEL_TYPES = ("directed", "forcing", "initiative", "pairwise forcing", "pairwise mutual", "pairwise joint", "double step 0.25", "double step 0.5", "double step 0.75", "double step 1", "contemporaneous")
BEHAVIOUR_TYPES = ("restricted", "absorbing")


@dataclass(frozen=True)
class Row:
    """One effect of a dependent variable: its short name, type, the covariates or variables it interacts with, its parameters."""

    variable: str
    short: str
    type: str = "eval"
    with_1: str = ""
    with_2: str = ""
    internal: float = 0.0
    theta: float = 0.0
    fixed: bool = False
    tested: bool = False
    included: bool = False

    @property
    def key(self) -> tuple:
        return (self.variable, self.short, self.type, self.with_1, self.with_2)


@dataclass(frozen=True)
class ModelOptions:
    """Kind of network and behaviour model, the largest outdegree (0: none) and an offset of the universal setting."""

    model: int = 1
    behaviour: int = 1
    most_out: int = 0
    offset: float = 0.0

    def __post_init__(self):
        if not 1 <= self.model <= len(MODEL_TYPES) or not 1 <= self.behaviour <= len(BEHAVIOUR_TYPES) or self.most_out < 0:
            raise ValueError("model options out of range")

    @property
    def name(self) -> str:
        return MODEL_TYPES[self.model - 1]


@dataclass(frozen=True)
class OutputOptions:
    """What a run returns and writes: simulated ends, chains, change contributions, and where."""

    outcomes: bool = False
    chains: bool = False
    contributions: bool = False
    folder: str | None = None


#: What a token's feature is made of.
_NEEDS = (("network", re.compile(r"[:\[,]w[dh]?\.")), ("dyadic", re.compile(r"[:\[,](d|wd)\.|dmean")), ("covariate", re.compile(r"(?<![\w.])(v|ego_v)(?!\w)|vmean|vrange|vsim")), ("category", re.compile(r"(?<![\w.])(c|ego_c)(?!\w)|cat:|size:|pair:|\|(hom|jump|same|diff|con|alldif|eqends)")), ("behaviour", re.compile(r"(?<![\w.])(z|z1|zr|zr1|ego_z\w*)(?!\w)|zrange|zsim|zmean|zvar|hist:|pair:|z1mean|z1ind")))


def needs(e: Effect) -> set[str]:
    """The kinds of data that an effect's statistic reads besides its dependent variable."""
    text = " ".join(TOKEN.findall(e.expression))
    return {kind for kind, pattern in _NEEDS if pattern.search(text)}


def of_behaviour(family: str) -> bool:
    return family.startswith("behaviour_")


def offered(variables: dict[str, str]) -> list[Row]:
    """All rows that a data set's variables offer, none included but the basic ones.

    variables: name -> "one-mode", "two-mode", "behaviour", "continuous", "covariate", "category" or "dyadic".
    """
    kinds: dict[str, list[str]] = {}
    for name, kind in variables.items():
        kinds.setdefault(kind, []).append(name)
    networks = kinds.get("one-mode", []) + kinds.get("two-mode", [])
    out: list[Row] = []
    for name, kind in variables.items():
        if kind not in ("one-mode", "two-mode", "behaviour", "continuous"):
            continue
        actor = kind in ("behaviour", "continuous")
        for family, members in catalogue.FAMILIES.items():
            if of_behaviour(family) != actor:
                continue
            for e in members:
                wanted = needs(e) - ({"behaviour"} if actor else set())
                partners = {
                    "network": [n for n in networks if n != name], "dyadic": kinds.get("dyadic", []), "covariate": kinds.get("covariate", []), "category": kinds.get("category", []), "behaviour": [n for n in kinds.get("behaviour", []) if n != name],
                }
                if actor and re.search(r":s\.", e.expression):
                    partners["network"] = networks
                    wanted = wanted | {"network"}
                if kind == "two-mode" and re.search(r"[:,]x\.[bme]|[:,]s\.[bme]", e.expression) and family in ("degree", "closure", "category", "primary", "setting_size"):
                    continue  # needs ties back to actors
                if any(not partners[w] for w in wanted):
                    continue
                type_ = "rate" if e.frame == "changes" or family == "behaviour_rate" else "gmm" if e.short.endswith("_gmm") or e.short in ("newrecip", "realrecip", "persistrecip", "agreetrans", "realtrans") else "eval"
                order = sorted(wanted)
                firsts = partners[order[0]] if order else [""]
                for first in firsts:
                    second = partners[order[1]][0] if len(order) > 1 else ""
                    basic = e.short in (("Rate", "density", "recip") if not actor else ("behRate", "linear", "quad")) and not (kind == "two-mode" and e.short == "recip")
                    out.append(Row(name, e.short, type_, first, second, included=basic))
                    if type_ == "eval" and e.frame == "ties":
                        out += [Row(name, e.short, t, first, second) for t in ("endow", "creation")]
    return out


def _changed(rows: list[Row], matches, change) -> list[Row]:
    out, hit = [], False
    for r in rows:
        found = matches(r)
        hit |= found
        out.append(change(r) if found else r)
    if not hit:
        raise ValueError("no such effect in the specification")
    return out


def _matcher(variable: str, short: str, type: str, with_1: str | None, with_2: str | None):
    catalogue.effect(short)
    return lambda r: (r.variable, r.short, r.type) == (variable, short, type) and with_1 in (None, r.with_1) and with_2 in (None, r.with_2)


def include(rows: list[Row], variable: str, *shorts: str, type: str = "eval", with_1: str | None = None, with_2: str | None = None, included: bool = True) -> list[Row]:
    """rows with these effects in the model, or out of it."""
    for short in shorts:
        rows = _changed(rows, _matcher(variable, short, type, with_1, with_2), lambda r: replace(r, included=included))
    return rows


def set_effect(rows: list[Row], variable: str, short: str, *, type: str = "eval", with_1: str | None = None, with_2: str | None = None, **values) -> list[Row]:
    """rows with this effect included and its internal, theta, fixed or tested values set."""
    if unknown := set(values) - {"internal", "theta", "fixed", "tested", "included"}:
        raise ValueError(f"no such values: {sorted(unknown)}")
    return _changed(rows, _matcher(variable, short, type, with_1, with_2), lambda r: replace(r, **({"included": True} | values)))


def update_theta(rows: list[Row], estimates: dict[tuple, float]) -> list[Row]:
    """rows whose effects, by (variable, short, type, with_1, with_2), start from earlier estimates where there are any."""
    return [replace(r, theta=estimates[r.key]) if r.key in estimates else r for r in rows]


def update_specification(rows: list[Row], other: list[Row]) -> list[Row]:
    """rows with everything that another specification has included, its parameters too; what rows don't offer is left out."""
    wanted = {r.key: r for r in other if r.included}
    return [replace(r, included=True, internal=w.internal, theta=w.theta, fixed=w.fixed, tested=w.tested) if (w := wanted.get(r.key)) else r for r in rows]


def gmm_statistics(rows: list[Row], variable: str, *shorts: str) -> list[Row]:
    """rows with further statistics of the generalised method of moments."""
    return include(rows, variable, *shorts, type="gmm")


def interaction_kind(e: Effect) -> str:
    """"ego" for an effect that is the same for all of an actor's ties, "dyadic" for one of the pair, "" for others."""
    if e.frame != "ties":
        return ""
    ends = {t.rpartition("@")[2] for t in TOKEN.findall(e.expression) if "@" in t}
    words = TOKEN.findall(e.expression)
    if words and ends <= {"i"} and not any(t.startswith(("on:", "ts:")) for t in words) and "x." not in e.expression:
        return "ego"
    return "" if re.search(r"(?<!\w)(ts|deg|nb|cat|far):x\.|:x\.|,x\.", e.expression.replace("{on:x.b}", "")) else "dyadic"


def interaction(*shorts: str) -> Effect:
    """The product of two or three effects as an effect of its own.

    Of effects on ties the product of what they count for a tie; all of them must be ego or dyadic ones, or all but
    one of them ego ones. Of behaviour effects that are an actor's value z times something, the product of
    the somethings times z, 0 where z is 0.
    """
    if len(shorts) not in (2, 3):
        raise ValueError("interactions are of two or three effects")
    parts = [catalogue.effect(s) for s in shorts]
    frames = {e.frame for e in parts}
    name = " x ".join(shorts)
    if frames == {"ties"}:
        kinds = [interaction_kind(e) for e in parts]
        if not all(kinds) and kinds.count("ego") < len(parts) - 1:
            raise ValueError(f"{name}: interactions are of ego and dyadic effects, or of one other effect and ego ones")
        return Effect(name, "ties", " * ".join(f"({e.expression})" for e in parts))
    families = [f for e in parts for f, members in catalogue.FAMILIES.items() if e in members]
    if frames == {"actors"} and all(of_behaviour(f) and f != "behaviour_rate" for f in families):
        product = " * ".join(f"({e.expression})" for e in parts)
        return Effect(name, "actors", f"(case when {catalogue.Z} = 0 then 0 else {product} / power({catalogue.Z}, {len(parts) - 1}) end)")
    raise ValueError(f"{name}: effects of different kinds of variables")


def time_dummies(effects: list[Effect], waves: int) -> list[Effect]:
    """For each effect and each period but the first, the effect in that period alone: names are "short:period"."""
    return [Effect(f"{e.short}:{m}", e.frame, f"(case when period = {m} then {e.expression} else 0 end)") for e in effects for m in range(2, waves)]


def documentation(spark: SparkSession) -> DataFrame:
    """(family, effect, frame, needs, statistic): the catalogue as a table."""
    rows = [(f, e.short, e.frame, ", ".join(sorted(needs(e))), e.expression) for f, members in catalogue.FAMILIES.items() for e in members]
    return spark.createDataFrame(rows, "family string, effect string, frame string, needs string, statistic string")


def table(spark: SparkSession, rows: list[Row], included: bool = True) -> DataFrame:
    """A specification as a DataFrame, its included rows or all."""
    kept = [r for r in rows if r.included or not included]
    return spark.createDataFrame([(r.variable, r.short, r.type, r.with_1, r.with_2, float(r.internal), float(r.theta), r.fixed, r.tested, r.included) for r in kept], "variable string, short string, type string, with_1 string, with_2 string, internal double, theta double, fixed boolean, tested boolean, included boolean")


#: Products of the registered query, on ties and of a behaviour.
PRODUCTS = (("egoX", "sameX"), ("simX", "crprod"), ("egoX", "recip"), ("egoX", "sameX", "crprod"))
BEHAVIOUR_PRODUCTS = (("avAlt", "indeg"), ("effFrom", "outdeg"))


def _queries():
    from tiewise.plans.features import SqlFeatures, features_of
    from tiewise.sources.panel import trade_panel

    ties, actors = [interaction(*p) for p in PRODUCTS], [interaction(*p) for p in BEHAVIOUR_PRODUCTS]

    def run(effects):
        return lambda spark, sf_dir: features_of(trade_panel(spark, sf_dir)).sums(effects)

    return {"interactions": run(ties), "behaviour_interactions": run(actors)}, {"interactions": SqlFeatures().sums(ties), "behaviour_interactions": SqlFeatures().sums(actors)}


QUERIES, QUERY_SQL = _queries()
