"""Run configurations from INI files."""

from __future__ import annotations

import configparser
from dataclasses import dataclass

from kernelfield.operators.grid import AXES
from kernelfield.plans.engine import Config
from kernelfield.sources import files


def _number(text: str) -> float | None:
    return None if text.strip() == "None" else float(text)


def _flag(text: str) -> bool:
    return text.strip().lower() in ("true", "1", "yes")


@dataclass(frozen=True)
class Run:
    """Paths, steps, array names, outputs, and the engine's configuration."""

    particles_path: str
    contacts_path: str
    output_path: str
    steps: tuple[int, ...]
    keys: dict[str, str | None]
    cube: bool
    images: bool
    engine: Config

    def file(self, which: str, t: int, ending: str = "vtp") -> str:
        return f"{self.particles_path if which == 'particles' else self.contacts_path}{t:04d}.{ending}"


def load(path: str, **changes) -> Run:
    """Reads a configuration; changes override fields of the engine's part."""
    ini = configparser.ConfigParser()
    ini.optionxform = str  # keys keep their case
    ini.read_string(files.content(path).decode(), path)
    grid = ini["grid_info"]
    wanted = {k: _flag(v) for k, v in ini.items("fields_to_export")}
    slices = wanted.pop("granular_temperature_slices", True)
    ranges = {a: (_number(grid[f"{a}_min"]), _number(grid[f"{a}_max"])) for a in AXES}
    axes = grid["grid_axes"]
    if len(axes) != int(grid["grid_dimension"]):
        raise ValueError("grid_axes and grid_dimension differ")
    settings = {
        "fields": tuple(k for k, v in wanted.items() if v),
        "kernel": ini["smoothing_function"]["type"],
        "axes": axes,
        "automatic_grid": _flag(grid["automatic_grid"]),
        "ranges": {a: r for a, r in ranges.items() if None not in r},
        "transects": {a: v for a in AXES if (v := _number(grid[f"{a}_transect"])) is not None},
        "periodic": tuple(_flag(grid[f"{a}_axis_periodic"]) for a in AXES),
        "phase_by": "none" if _flag(ini["flags"]["partialignore"]) else "kmeans",
        "slices": slices,
    }
    t = ini["timesteps"]
    return Run(
        ini["paths"]["particles_path"],
        ini["paths"]["contacts_path"],
        ini["paths"]["output_path"],
        tuple(range(int(t["t0"]), int(t["tf"]) + 1, int(t["dt"]))),
        {k: None if v == "None" else v for k, v in ini.items("key_mapping")},
        _flag(ini["output_options"]["h5_output"]),
        _flag(ini["output_options"]["vkthdf_output"]),
        Config(**settings | changes),
    )
