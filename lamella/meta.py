"""Metadata of pyramids: axes, layers, label colours and properties, and their JSON form (multiscales 0.4).

All of it is small and lives on the driver; no per-row column repeats it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

KINDS = {"t": "time", "c": "channel", "z": "space", "y": "space", "x": "space"}
UNITS = {"t": "Frame", "c": "Channel", "z": "Slice", "y": "Pixel", "x": "Pixel"}
ORDER = "tczyx"
VERSION = "0.4"


@dataclass(frozen=True)
class Layer:
    """Shape, scale and storage of one resolution."""

    shape: tuple[int, ...]
    scale: tuple[float, ...]
    translation: tuple[float, ...] | None = None
    dtype: str = "int64"
    chunks: tuple[int, ...] = ()
    compressor: str | None = "zlib"
    separator: str = "."

    def physical_size(self) -> tuple[float, ...]:
        return tuple(s * n for s, n in zip(self.scale, self.shape))


@dataclass(frozen=True)
class Meta:
    """Axes and layers; layer names are ordered by number where they are numbers."""

    axes: str
    layers: dict[str, Layer]
    units: tuple[str, ...] = ()
    name: str = "image"
    labels: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(set(self.axes)) != len(self.axes) or any(a not in KINDS for a in self.axes):
            raise ValueError(f"axes must be different letters of {ORDER}: {self.axes!r}")
        if not self.layers:
            raise ValueError("a pyramid needs a layer")
        for path, layer in self.layers.items():
            if not len(layer.shape) == len(layer.scale) == len(self.axes):
                raise ValueError(f"layer {path!r} doesn't have {len(self.axes)} dimensions")
        if not self.units:
            object.__setattr__(self, "units", tuple(UNITS[a] for a in self.axes))
        object.__setattr__(self, "layers", {p: self.layers[p] for p in sorted(self.layers, key=path_order)})

    @property
    def paths(self) -> list[str]:
        return list(self.layers)

    @property
    def reference(self) -> str:
        """The full resolution: layer '0', else the first."""
        return "0" if "0" in self.layers else self.paths[0]

    def index(self, axis: str) -> int:
        if axis not in self.axes:
            raise ValueError(f"no axis {axis!r} in {self.axes!r}")
        return self.axes.index(axis)

    def axis_length(self, axis: str, path: str | None = None) -> int:
        return self.layers[path or self.reference].shape[self.index(axis)]

    def scale_factor(self, path: str) -> tuple[float, ...]:
        return tuple(a / b for a, b in zip(self.layers[self.reference].shape, self.layers[path].shape))

    def retag(self, name: str) -> Meta:
        return replace(self, name=name)

    def rename_paths(self) -> Meta:
        return replace(self, layers={str(k): layer for k, layer in enumerate(self.layers.values())})

    def drop_axis(self, axis: str) -> Meta:
        k = self.index(axis)
        cut = lambda t: t[:k] + t[k + 1 :] if t else t
        layers = {p: replace(x, shape=cut(x.shape), scale=cut(x.scale), translation=cut(x.translation), chunks=cut(x.chunks)) for p, x in self.layers.items()}
        return replace(self, axes=cut(self.axes), units=cut(self.units), layers=layers)

    def update_units(self, units: dict[str, str] | list[str]) -> Meta:
        if isinstance(units, dict):
            units = [units.get(a, u) for a, u in zip(self.axes, self.units)]
        if len(units) != len(self.axes):
            raise ValueError("one unit for each axis is needed")
        return replace(self, units=tuple(units))

    def update_scales(self, scale: dict[str, float] | list[float]) -> Meta:
        """Set the reference layer's scale; other layers keep their ratio of shapes to it."""
        ref = self.layers[self.reference]
        if isinstance(scale, dict):
            scale = [scale.get(a, s) for a, s in zip(self.axes, ref.scale)]
        layers = {p: replace(x, scale=tuple(s * f for s, f in zip(scale, self.scale_factor(p)))) for p, x in self.layers.items()}
        return replace(self, layers=layers)

    def update_translations(self, translation: list[float], path: str | None = None) -> Meta:
        layers = {p: replace(x, translation=tuple(translation)) if path in (None, p) else x for p, x in self.layers.items()}
        return replace(self, layers=layers)

    def to_json(self) -> dict[str, Any]:
        """The ``multiscales`` document; scale comes first, translation second."""
        datasets = []
        for path, layer in self.layers.items():
            steps: list[dict[str, Any]] = [{"type": "scale", "scale": list(layer.scale)}]
            if layer.translation is not None:
                steps.append({"type": "translation", "translation": list(layer.translation)})
            datasets.append({"path": path, "coordinateTransformations": steps})
        axes = [{"name": a, "type": KINDS[a], "unit": u} for a, u in zip(self.axes, self.units)]
        return {"multiscales": [{"axes": axes, "datasets": datasets, "name": self.name, "version": VERSION}]}

    @staticmethod
    def from_json(document: dict[str, Any], arrays: dict[str, Layer]) -> Meta:
        """Read a ``multiscales`` document; ``arrays`` has what the arrays themselves say."""
        found = document.get("multiscales")
        if not found or "axes" not in found[0] or "datasets" not in found[0]:
            raise ValueError("no multiscales with axes and datasets")
        one = found[0]
        layers = {}
        for d in one["datasets"]:
            if d["path"] not in arrays:
                continue
            parts = {t["type"]: t[t["type"]] for t in d.get("coordinateTransformations", [])}
            layer = arrays[d["path"]]
            move = parts.get("translation")
            layers[d["path"]] = replace(layer, scale=tuple(parts.get("scale", layer.scale)), translation=tuple(move) if move is not None else None)
        axes = "".join(a["name"] for a in one["axes"])
        return Meta(axes, layers, tuple(a.get("unit", UNITS[a["name"]]) for a in one["axes"]), one.get("name", "image"))


@dataclass
class ImageLabelMeta:
    """Colours and properties of integer labels, sorted by label, with keyed upserts."""

    colors: dict[int, tuple[int, ...]] = field(default_factory=dict)
    properties: dict[int, dict[str, Any]] = field(default_factory=dict)

    def add_color(self, label: int, rgba: tuple[int, ...]) -> None:
        if not isinstance(label, int):
            raise ValueError("label values are integers")
        self.colors[label] = tuple(rgba)

    def add_property(self, label: int, **values: Any) -> None:
        self.properties[label] = self.properties.get(label, {}) | values

    def to_json(self) -> dict[str, Any]:
        if not self.colors:
            raise ValueError("image-label needs colors")
        return {"image-label": {"colors": [{"label-value": k, "rgba": list(v)} for k, v in sorted(self.colors.items())], "properties": [{"label-value": k} | v for k, v in sorted(self.properties.items())], "version": VERSION}}

    @staticmethod
    def from_json(document: dict[str, Any]) -> ImageLabelMeta:
        one = document.get("image-label", {})
        if not one.get("colors"):
            raise ValueError("image-label needs colors")
        rows = {p["label-value"]: {k: v for k, v in p.items() if k != "label-value"} for p in one.get("properties", [])}
        return ImageLabelMeta({c["label-value"]: tuple(c["rgba"]) for c in one["colors"]}, rows)


def path_order(path: str) -> tuple:
    return (0, int(path), path) if path.isdigit() else (1, 0, path)


def shrunk_shape(shape: tuple[int, ...], factor: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(-(-n // f) for n, f in zip(shape, factor))


def default_chunks(shape: tuple[int, ...]) -> tuple[int, ...]:
    """At most 256 on the last three axes, 1 on all others."""
    return tuple(min(256, n) if k >= len(shape) - 3 else 1 for k, n in enumerate(shape))


def planned_shapes(shape: tuple[int, ...], factor: tuple[float, ...], layers: int) -> list[tuple[int, ...]]:
    """Shapes of independently made layers: rounded, at least 1."""
    return [tuple(max(1, round(n / f**k)) for n, f in zip(shape, factor)) for k in range(layers)]
