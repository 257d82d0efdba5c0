"""End-to-end run over small hand-written delimited inputs in the original file layout."""

import os
import random

from trialspark.plans import analysis as AN
from trialspark.plans import model as MD

META_NUM = AN.META_KEEP[5:]


def _write(path, header, rows, sep="\t"):
    with open(path, "w") as f:
        f.write(sep.join(header) + "\n")
        for r in rows:
            f.write(sep.join("NA" if v is None else str(v) for v in r) + "\n")
    return str(path)


def make_inputs(d):
    rnd = random.Random(5)
    locs, years, hybrids = ["IAH1", "NEH1", "MOH1"], [2019, 2020, 2021, 2022, 2023], [f"G{i}" for i in range(6)]
    trait = []
    for loc in locs:
        for y in years:
            for h in hybrids:
                reps = [1] if loc == "MOH1" else [1, 2]
                for rep in reps:
                    for _ in range(2):
                        v = None if rnd.random() < 0.05 else round(8 + rnd.gauss(0, 1) + hybrids.index(h) * 0.3, 3)
                        trait.append((f"{loc}_{y}", h, y, loc, "E1", rep, rnd.randint(1, 4), v))
    trait_p = _write(d / "trait.csv", ["Env", "Hybrid", "Year", "Field_Location", "Experiment", "Replicate",
                                       "Block", "Yield_Mg_ha"], trait, sep=",")
    envs = [f"{loc}_{y}" for loc in locs for y in years]
    meta_h = AN.META_KEEP + ["Farm"]
    meta = [[e, "std", "C", "soy", "no"] + [None if rnd.random() < 0.1 else round(rnd.uniform(30, 45), 2)
                                            for _ in META_NUM] + ["F"] for e in envs]
    weather_h = ["Env", "Date"] + [f"W{i}" for i in range(16)] + ["extra"]
    weather = []
    for e in envs + ["MOH1_1_2020", "MOH1_2_2020"]:
        for day in range(3):
            weather.append([e, f"2020-01-0{day + 1}"] + [round(rnd.uniform(0, 30), 1) for _ in range(16)] + [1])
    ec = [[e, round(rnd.uniform(0, 1), 3), round(rnd.uniform(0, 1), 3)] for e in envs for _ in range(2)]
    soil_h = ["Env"] + [f"S{i}" for i in range(36)]
    soil = [[e] + [round(rnd.uniform(0, 9), 2) for _ in range(36)] for e in envs]
    test_envs = [f"{loc}_2024" for loc in locs]
    template = [(e, h, None) for e in test_envs for h in hybrids + ["G9"]]
    geno_h = ["Genotype"] + [f"m{i}" for i in range(8)]
    geno = [[h] + [rnd.choice([0, 0.5, 1, None]) for _ in range(8)] for h in hybrids]
    return AN.Inputs(
        trait=trait_p,
        meta=_write(d / "meta.csv", meta_h, meta, sep=","),
        weather=_write(d / "weather.csv", weather_h, weather, sep=","),
        ec=_write(d / "ec.csv", ["Env", "CumHI30_pFloFla", "E2"], ec, sep=","),
        soil=_write(d / "soil.csv", soil_h, soil, sep=","),
        template=_write(d / "template.csv", ["Env", "Hybrid", "Yield_Mg_ha"], template, sep=","),
        test_meta=_write(d / "tmeta.csv", meta_h, [[e, "std", "C", "soy", "no"] + [40.0] * len(META_NUM) + ["F"]
                                                    for e in test_envs], sep=","),
        test_weather=_write(d / "tweather.csv", weather_h,
                            [[e, "2024-01-01"] + [1.0] * 16 + [1] for e in test_envs], sep=","),
        test_ec=_write(d / "tec.csv", ["Env", "CumHI30_pFloFla", "E2"], [[e, 0.5, None] for e in test_envs], sep=","),
        test_soil=_write(d / "tsoil.csv", soil_h, [[e] + [1.0] * 36 for e in test_envs], sep=","),
        genotype=_write(d / "geno.txt", geno_h, geno),
    )


def test_end_to_end(spark, tmp_path):
    inp = make_inputs(tmp_path)
    out = str(tmp_path / "out")
    space = dict(MD.BOOSTED_SPACE, n_estimators=(1, 2, "log-uniform"), max_depth=(2, 3, "log-uniform"))
    recipes = {k: AN.Recipe(r.genotype, r.kind, r.folds, space, 1) for k, r in AN.RECIPES.items()}
    weights = spark.createDataFrame([("additive", 4.0), ("dominance", 1.0), ("residual", 3.0)], "component string, V double")
    res = AN.run(spark, inp, out, recipes, weights)
    for name in ["Pheno_data_Outlier", "Pheno_data_without_Outlier", "Phenotype_Blue", "PhenoWeather", "PhenoEC", "PhenoMetal", "PhenoSoil",
                 "TestPhenoweather", "TestPhenoEC", "TestPhenometal", "TestPhenoSoil", "Genotype_True",
                 "Genomic_addev_matrix", "Genomic_dodev_matrix",
                 *[f"predictions_{k}" for k in [*AN.RECIPES, "weighted2", "weighted3", "learners"]]]:
        assert os.path.isdir(os.path.join(out, name)), name
    # one prediction per template row; G9 has no genotype and still gets one
    for df in res["predictions"].values():
        assert df.count() == 21
    assert res["flagged"].filter("out_flag = 0").count() == res["clean"].count()
    pheno = res["phenotype"]
    assert set(pheno.columns) == {"Hybrid", "Field_Location", "Year", "Env", "Hybrid_Env", "Yield_Mg_ha"}
    # weather: 16 measures by position, sub-site codes merged into MOH1_2020
    pw = res["PhenoWeather"]
    assert [c for c in pw.columns if c.startswith("W")] == [f"W{i}" for i in range(16)]
    assert pw.filter("Env = 'MOH1_2020'").filter("W0 is null").count() == 0
    # metadata: text columns dropped, numeric NULLs imputed within location
    pm = res["PhenoMetal"]
    assert "Treatment" not in pm.columns and "Farm" not in pm.columns
    assert pm.filter(" or ".join(f"`{c}` is null" for c in META_NUM)).count() == 0
    # soil: positions 2-6 and 30-37 dropped after the location/year split
    # (Env, Field_Location, Year, S0.. -> S_k sits at position k + 4)
    ps = res["PhenoSoil"]
    soil = [c for c in ps.columns if c.startswith("S")]
    assert soil == [f"S{k}" for k in range(3, 26)] + ["S34", "S35"]
