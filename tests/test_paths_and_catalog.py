"""Signal paths from calibrations and names, and the observed catalog kept up to date."""

from __future__ import annotations

import json
import random

import pytest

from tonelake.operators import paths
from tonelake.sources import observed

SPECS = "pack string, path string, kind string, unit string, low double, high double, writable boolean, needs_review boolean, encoding string"
MEMBERS = "pack string, path string, member long, label string"
MANIFESTS = "pack string, calibration string, amps map<string,string>"


def spec(pack, path, kind="metered", unit=None, low=None, high=None, writable=True):
    return (pack, path, kind, unit, low, high, writable, False, None)


def own(pack):
    """The parameters of a pack with two channels."""
    out = [spec(pack, f"eq/band{k}", unit="dB", low=-12.0, high=12.0) for k in (1, 2)]
    out += [spec(pack, "/out", unit="DB"), spec(pack, "ch/level", "rotation"), spec(pack, "/channel", "enum"), spec(pack, "eq/on", "switch"), spec(pack, "eq/hpf", unit="hz"), spec(pack, "sys/fixed", writable=False), spec(pack, "ms/out", unit="ms")]
    return out


GOOD = {
    "output_gain_control": "out",
    "settings": {"eq/on": False, "ch/level": 10},
    "signal_paths": {
        "lead": {"settings": {"ch/level": 30}, "selection_settings": {"channel": "Lead"}, "volume_control": "ch/level", "eq_band_controls": ["eq/band1", "eq/band2"], "eq_enable_controls": ["eq/on"], "eq_hpf_control": "eq/hpf"},
        "clean": {"selection_settings": {"channel": 0}},
    },
}


def read(spark, calibrations, amps=None, specs=None):
    """Paths and faults of packs that have the parameters of own() and these calibrations."""
    manifests = spark.createDataFrame([(p, c if c is None or isinstance(c, str) else json.dumps(c), amps) for p, c in calibrations.items()], MANIFESTS)
    specs = spark.createDataFrame(specs if specs is not None else [s for p in calibrations for s in own(p)], SPECS)
    members = spark.createDataFrame([(p, "/channel", k, n) for p in calibrations for k, n in enumerate(("Clean", "Lead"))], MEMBERS)
    found, faults = paths.signal_paths(manifests, specs, members)
    return manifests, found, {(r.pack, r.name, r.rule, r.detail) for r in faults.collect()}


def test_declared_paths(spark):
    manifests, found, faults = read(spark, {"p": GOOD})
    assert faults == set()
    got = {r.name: r for r in found.collect()}
    lead, clean = got["lead"], got["clean"]
    assert lead.settings == {"eq/on": "false", "ch/level": "30", "channel": "Lead"} and lead.selection == {"channel": "Lead"}
    assert (lead.volume, lead.bands, lead.enables, lead.hpf, lead.lpf, lead.output) == ("ch/level", ["eq/band1", "eq/band2"], ["eq/on"], "eq/hpf", None, "out")
    assert clean.settings == {"eq/on": "false", "ch/level": "10", "channel": "0"} and (clean.volume, clean.bands) == (None, [])
    asked = spark.createDataFrame([("p", a) for a in ("LEAD", "lead", "0", "other", None)] + [("q", "lead")], "pack string, asked string")
    got = {(r.pack, r.asked): (r.name, r.selection) for r in paths.resolved(asked, found, manifests).collect()}
    assert got == {("p", "LEAD"): ("lead", {"channel": "Lead"}), ("p", "lead"): ("lead", {"channel": "Lead"}), ("p", "0"): ("clean", {"channel": "0"}), ("p", "other"): (None, None), ("p", None): (None, None), ("q", "lead"): (None, None)}


def changed(at, value):
    out = json.loads(json.dumps(GOOD))
    *way, last = at.split(".")
    x = out
    for w in way:
        x = x[w]
    x[last] = value
    return out


FAULTS = {
    "text": ("{broken", (None, "calibration is no object", None)),
    "list": ("[1]", (None, "calibration is no object", None)),
    "empty": ({"signal_paths": {}}, (None, "signal_paths is no object with members", None)),
    "array": ({"signal_paths": [1]}, (None, "signal_paths is no object with members", None)),
    "common": (changed("settings", [1]), (None, "calibration settings are no object", None)),
    "nocommon": (changed("settings", None), (None, "calibration settings are no object", None)),
    "row": (changed("signal_paths.lead", "x"), ("lead", "path is no object", None)),
    "nullrow": (changed("signal_paths.lead", None), ("lead", "path is no object", None)),
    "local": (changed("signal_paths.lead.settings", 5), ("lead", "settings are no object", None)),
    "selection": (changed("signal_paths.lead.selection_settings", None), ("lead", "selection settings are no object", None)),
    "twice": (changed("signal_paths.lead.settings", {"channel": 1, "ch/level": 3}), ("lead", "set and selected by", "channel")),
    "unknown": (changed("signal_paths.lead.settings", {"no/such": 1}), ("lead", "setting: unknown", "no/such")),
    "value": (changed("signal_paths.lead.settings", {"ch/level": "loud"}), ("lead", "setting: no value of this kind", "ch/level")),
    "range": (changed("signal_paths.lead.settings", {"eq/band1": 99}), ("lead", "setting: outside the range", "eq/band1")),
    "member": (changed("signal_paths.lead.selection_settings", {"channel": "Crunch"}), ("lead", "setting: no value of this kind", "channel")),
    "fixed": (changed("signal_paths.lead.volume_control", "sys/fixed"), ("lead", "volume: read-only", "sys/fixed")),
    "volume": (changed("signal_paths.lead.volume_control", "no/volume"), ("lead", "volume: unknown", "no/volume")),
    "number": (changed("signal_paths.lead.volume_control", 3), ("lead", "names no parameter", "volume")),
    "blank": (changed("signal_paths.lead.eq_hpf_control", ""), ("lead", "names no parameter", "hpf")),
    "output": (changed("output_gain_control", "ms/out"), ("lead", "output is not in dB", "ms/out")),
    "bands": (changed("signal_paths.lead.eq_band_controls", "eq/band1"), ("lead", "controls are no list", "bands")),
    "nobands": (changed("signal_paths.lead.eq_band_controls", None), ("lead", "controls are no list", "bands")),
    "item": (changed("signal_paths.lead.eq_band_controls", ["eq/band1", 4]), ("lead", "list names no parameter", "bands")),
    "repeat": (changed("signal_paths.lead.eq_band_controls", ["eq/band1", "eq/band1"]), ("lead", "list repeats a control", "bands")),
    "enable": (changed("signal_paths.lead.eq_enable_controls", ["eq/off"]), ("lead", "enables: unknown", "eq/off")),
    "nothing": (None, (None, "no signal path", None)),
    "null": ({"signal_paths": None}, (None, "no signal path", None)),
}


def test_every_fault_is_a_row(spark):
    _, found, faults = read(spark, {p: c for p, (c, _) in FAULTS.items()} | {"good": GOOD})
    assert {r.pack for r in found.collect()} == {"good"} and "good" not in {f[0] for f in faults}
    for pack, (_, want) in FAULTS.items():
        mine = {f[1:] for f in faults if f[0] == pack}
        assert want in mine, pack
        assert len(mine) == 1 or pack == "output", (pack, mine)  # an output is shared by all paths


def test_paths_by_amp(spark):
    control = {"a": ["aAmp/aVolume", "aEQ/aEQBand1", "aEQ/aEQBand2", "aEQ/aEQBand4", "aEQ/aEQActive", "aEQ/aEQLpf"], "b": ["bEQ/bEQBand1"], "c": ["cEQ/cEQBand2"]}
    specs = [spec("p", c) for cs in control.values() for c in cs] + [spec("p", "parameters/gateActive", "switch"), spec("p", "eqParameters/sectionActive", "switch"), spec("p", "parameters/outputGain", unit="dB"), spec("p", "/selectedAmp", "string")]
    manifests, found, faults = read(spark, {"p": "{}"}, {"Amp A": "a", "Also A": "a", "Amp B": "b", "Amp C": "c"}, specs)
    assert faults == set()
    got = {r.name: r for r in found.collect()}
    assert got.keys() == {"a", "b"}
    assert got["a"].settings == {"/selectedAmp": "Amp A", "parameters/gateActive": "false"} and got["a"].selection == {"/selectedAmp": "Amp A"}
    assert got["a"].bands == ["aEQ/aEQBand1", "aEQ/aEQBand2"] and got["a"].enables == ["aEQ/aEQActive", "eqParameters/sectionActive"]
    assert (got["a"].volume, got["a"].hpf, got["a"].lpf, got["a"].output) == ("aAmp/aVolume", None, "aEQ/aEQLpf", "parameters/outputGain")
    assert got["b"].volume is None and got["b"].enables == ["eqParameters/sectionActive"]
    asked = spark.createDataFrame([("p", "also a"), ("p", "B"), ("p", "Amp C")], "pack string, asked string")
    assert {r.asked: r.name for r in paths.resolved(asked, found, manifests).collect()} == {"also a": "a", "B": "b", "Amp C": None}
    unit = [s if s[1] != "parameters/outputGain" else spec("p", s[1], unit="ms") for s in specs]
    _, found, faults = read(spark, {"p": None}, {"Amp A": "a"}, unit)
    assert faults == {("p", "a", "output is not in dB", "parameters/outputGain")} and found.collect() == []
    assert read(spark, {"p": None}, {}, [])[2] == {("p", None, "no signal path", None)}


ENTRIES = "file string, position long, module string, key string, value string"


def everything(spark, folder):
    sights = {(r.module, r.key, r.value): ((r.first.file, r.first.position), r.files) for r in observed.load(spark, folder).collect()}
    return sights, {(r.module, r.key): r.files for r in observed.load(spark, folder, "parameters").collect()}, {r.file for r in observed.load(spark, folder, "files").collect()}


def test_any_split_gives_the_same_catalog(spark, tmp_path):
    rng = random.Random(4)
    files = {f"f{k}": [(p, rng.choice([None, "", "m", "n"]), rng.choice("ab"), rng.choice(["1", "2", None])) for p in range(rng.randrange(1, 9))] for k in range(9)}
    want = ({}, {}, set(files))
    for f, rows in files.items():
        for m, k, v in {(m or "", k, v) for _, m, k, v in rows}:
            first = (f, min(p for p, *e in rows if [e[0] or "", e[1], e[2]] == [m, k, v]))
            old, n = want[0].get((m, k, v), (first, 0))
            want[0][m, k, v] = min(old, first), n + 1
        for m, k in {(m or "", k) for _, m, k, _ in rows}:
            want[1][m, k] = want[1].get((m, k), 0) + 1
    names = sorted(files)
    for n, batches in enumerate(([names], [names[6:], names[:3], names[3:6]], [names[:5], names[:5], names[4:]])):
        folder = str(tmp_path / f"c{n}")
        for batch in batches:
            rows = [(f, *e) for f in batch for e in files[f]] + [(None, 1, "m", "a", "9"), ("x", 1, "m", None, "9")]
            observed.merge(spark, folder, spark.createDataFrame(rows + rows[:3], ENTRIES))
        assert everything(spark, folder) == want
        assert observed.summary(spark, folder).first().asDict() == {"parameters": len(want[1]), "presets": 9}
        assert len(list((tmp_path / f"c{n}").iterdir())) <= 2


def test_unfinished_missing_and_broken_catalogs(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert everything(spark, folder) == ({}, {}, set()) and observed.summary(spark, folder).first().asDict() == {"parameters": 0, "presets": 0}
    observed.merge(spark, folder, spark.createDataFrame([("f", 1, "m", "a", "1")], ENTRIES))
    before = everything(spark, folder)
    half = tmp_path / "c" / "v0000000002"
    half.mkdir()
    (half / "sights").mkdir()
    assert everything(spark, folder) == before
    observed.merge(spark, folder, spark.createDataFrame([("f", 1, "m", "a", "2"), ("g", 5, "m", "a", "1")], ENTRIES))
    assert everything(spark, folder) == ({("m", "a", "1"): (("f", 1), 2)}, {("m", "a"): 2}, {"f", "g"}) and not half.exists()
    for part in (tmp_path / "c" / "v0000000003" / "sights").glob("*.parquet"):
        part.write_bytes(b"no parquet")
    for crc in (tmp_path / "c" / "v0000000003" / "sights").glob(".*.crc"):
        crc.unlink()
    assert observed.index(spark, folder).collect() == []
    with pytest.raises(Exception):
        observed.merge(spark, folder, spark.createDataFrame([("h", 1, "m", "a", "1")], ENTRIES))
