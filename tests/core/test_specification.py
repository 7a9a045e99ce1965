import pytest

from tiewise.operators import effects, specification as spec


def rows():
    return spec.offered({"friends": "one-mode", "advice": "one-mode", "clubs": "two-mode", "drink": "behaviour", "age": "covariate", "sex": "category", "near": "dyadic"})


def test_what_data_offer():
    every = rows()
    of = lambda v, t="eval": {r.short for r in every if r.variable == v and r.type == t}
    assert {"density", "recip", "transTrip", "egoX", "sameX", "crprod", "X"} <= of("friends") and "Rate" in of("friends", "rate") and "linear" not in of("friends")
    assert "density" in of("clubs") and "recip" not in of("clubs") and {"linear", "avAlt", "effFrom"} <= of("drink") and "newrecip" in of("friends", "gmm")
    alone = {r.short for r in spec.offered({"friends": "one-mode"})}
    assert "recip" in alone and not {"egoX", "sameX", "crprod", "X", "altDist2W"} & alone
    assert {r.with_1 for r in every if r.variable == "friends" and r.short == "crprod"} == {"advice", "clubs"}
    assert {(r.variable, r.short) for r in every if r.included} == {("friends", "Rate"), ("friends", "density"), ("friends", "recip"), ("advice", "Rate"), ("advice", "density"), ("advice", "recip"), ("clubs", "Rate"), ("clubs", "density"), ("drink", "behRate"), ("drink", "linear"), ("drink", "quad")}


def test_changing_a_specification(spark):
    r = spec.include(rows(), "friends", "transTrip", "cycle3")
    r = spec.set_effect(r, "friends", "egoX", theta=0.4, fixed=True, tested=True)
    r = spec.include(r, "friends", "cycle3", included=False)
    chosen = {x.short: x for x in r if x.variable == "friends" and x.included and x.type == "eval"}
    assert set(chosen) == {"density", "recip", "transTrip", "egoX"} and chosen["egoX"].theta == 0.4 and chosen["egoX"].fixed
    new = spec.update_specification(rows(), r)
    assert {x.key for x in new if x.included} == {x.key for x in r if x.included}
    assert next(x for x in spec.update_theta(new, {("friends", "recip", "eval", "", ""): 1.5}) if x.short == "recip").theta == 1.5
    assert [x.short for x in spec.gmm_statistics(rows(), "friends", "newrecip") if x.type == "gmm" and x.included] == ["newrecip"]
    assert spec.table(spark, r).count() == len([x for x in r if x.included])
    for bad in (lambda: spec.include(rows(), "friends", "nothing"), lambda: spec.include(rows(), "clubs", "recip"), lambda: spec.set_effect(rows(), "friends", "recip", colour=1), lambda: spec.include(rows(), "friends", "susceptCovar")):
        with pytest.raises(ValueError):
            bad()
    assert spec.ModelOptions(3).name == "initiative"
    with pytest.raises(ValueError):
        spec.ModelOptions(12)


def test_interactions():
    assert spec.interaction_kind(effects.effect("egoX")) == "ego" and spec.interaction_kind(effects.effect("sameX")) == "dyadic" and spec.interaction_kind(effects.effect("transTrip")) == ""
    assert spec.interaction("egoX", "transTrip").frame == "ties"
    for bad in (("transTrip", "sameX"), ("egoX", "linear"), ("egoX",), ("outAct", "outIso")):
        with pytest.raises(ValueError):
            spec.interaction(*bad)
    assert [e.short for e in spec.time_dummies([effects.effect("recip")], 4)] == ["recip:2", "recip:3"]


def test_documentation(spark):
    assert spec.documentation(spark).count() == sum(map(len, effects.FAMILIES.values()))
