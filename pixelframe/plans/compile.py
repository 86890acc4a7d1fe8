"""From a recipe to a lazy DataFrame plan.

Operations run in order. Each asks for the space it works in; the frame converts only when that changes. The first
operation's space decides how code values are read. Masks of one id, size and treatment are planned once a recipe.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import LINEAR, SRGB, Extent, PixelFrame, from_channels, from_codes, from_sizes
from ..operators import color, composite, filters, geometry, masks
from ..sources.svg import Drawing
from .presets import recipe_of
from .recipe import MASKED, parse, recipe_hash, validate

FORMATS = ("jpeg", "png", "webp", "avif")

#: Operations and the functions that plan them.
RUN: dict[str, Callable[..., PixelFrame]] = {
    "rotate": geometry.rotate, "crop": geometry.crop, "resize": geometry.resize, "perspective": geometry.perspective, "flip": geometry.flip,
    "adjust": color.adjust, "color_matrix": color.color_matrix, "curves": color.curves, "levels": color.levels, "white_balance": color.white_balance,
    "hsl": color.hsl, "gradient_map": color.gradient_map, "auto_levels": color.auto_levels, "vignette": color.vignette, "grain": color.grain,
    "blur": filters.blur, "median": filters.median, "unsharp_mask": filters.unsharp_mask, "convolve": filters.convolve, "clone": filters.clone,
    "heal": filters.heal, "pixelate": filters.pixelate,
}
LINEAR_FIRST = frozenset({"rotate", "resize", "perspective", "white_balance", "vignette", "blur", "median", "unsharp_mask", "convolve", "clone", "heal", "pixelate"})
NO_SPACE = frozenset({"auto_orient", "crop", "flip", "encode", "strip_metadata"})
#: Pixels to which an input and a result are bounded.
MOST_PIXELS = 100_000_000


@dataclass
class Output:
    frame: PixelFrame
    recipe_hash: str
    format: str
    quality: int | None
    bit_depth: int
    warnings: list[str] = field(default_factory=list)


def first_space(recipe: dict) -> str:
    if recipe.get("layers"):
        return SRGB
    for op in recipe["operations"]:
        if op["op"] not in NO_SPACE:
            return LINEAR if op["op"] in LINEAR_FIRST else SRGB
    return SRGB


class Planner:
    """``assets``: revision_id -> PixelFrame, sources.svg.Drawing or sources.cube.Cube."""

    def __init__(self, assets: Mapping[str, Any] | None = None, images: int = 1):
        self.assets, self.images = assets or {}, images
        self.planes: dict[tuple, DataFrame] = {}
        self.warnings: list[str] = []

    def shared(self, asset: Any) -> Any:
        """An asset that is image 0, for each of the images that a recipe runs over."""
        if self.images == 1 or not isinstance(asset, PixelFrame):
            return asset
        each = F.explode(F.sequence(F.lit(0), F.lit(self.images - 1))).alias("image_id")
        return replace(asset, df=asset.df.filter("image_id = 0").select(each, *[c for c in asset.df.columns if c != "image_id"]))

    def asset(self, revision_id: str):
        if revision_id not in self.assets:
            raise KeyError(f"revision {revision_id} is not known")
        return self.shared(self.assets[revision_id])

    def plane(self, mask: Mapping, p: PixelFrame) -> DataFrame:
        key = (mask["revision_id"], mask["invert"], mask["feather_px"], *p.each(lambda e: (e.width, e.height)))
        if key not in self.planes:
            # masks are read as they are stored, whatever way up they are to be shown
            read = getattr(self.assets, "mask", self.asset)
            self.planes[key] = masks.plane_for(self.shared(read(mask["revision_id"])), p, mask["invert"], mask["feather_px"])
        return self.planes[key]

    def warn(self, p: PixelFrame, name: str, params: Mapping) -> None:
        """What an operation loses or adds, told before it runs; for images of several sizes, of how many, and of the worst."""
        told = [w for e in p.shapes if (w := self._lost(e, name, params))]
        if told:
            self.warnings.append((f"{len(told)} of {len(p.shapes)} sizes, at worst: " if p.mixed else "") + max(told)[1])

    def _lost(self, e: Extent, name: str, params: Mapping) -> tuple[float, str] | None:
        """A measure, and words for it."""
        if name == "rotate" and params.get("crop", "largest_inscribed_rect") != "full" and (lost := geometry.rotation_loss(e.width, e.height, params["angle_degrees"])):
            w, h = geometry.inscribed(e.width, e.height, params["angle_degrees"])
            return lost, f"turning leaves {w}x{h} of {e.width}x{e.height} pixels, {lost:.1f} per cent less"
        if name == "perspective":
            quad = {k: v for k, v in params.items() if k != "pad_color"}
            step, w, h = geometry.perspective_step(e.width, e.height, **quad)
            if padded := geometry.padding_share(e.width, e.height, step, w, h):
                return padded, f"{padded * 100:.1f} per cent of the result's {w}x{h} pixels have no source and are padded"
        if name == "crop" and params.get("rect") and params.get("coordinate_space") == "source":
            x0, y0, x1, y1 = geometry.source_box(e, *(int(params["rect"][k]) for k in ("x", "y", "width", "height")))
            out = max(-x0, -y0, x1 - e.width, y1 - e.height)
            if out > 0:
                return out, f"the rectangle to crop reaches beyond the {e.width}x{e.height} image; its part inside is taken"
        return None

    def operation(self, p: PixelFrame, op: Mapping) -> PixelFrame:
        name, params = op["op"], {k: v for k, v in op.items() if k not in ("op", "mask")}
        if name in ("auto_orient", "encode", "strip_metadata"):
            return p
        if name == "lut":
            after = color.lut(p, self.asset(params["lut_revision_id"]), params["strength"])
        elif name == "svg_overlay":
            top = self.asset(params["svg_revision_id"])
            if isinstance(top, Drawing):
                self.warnings += [f"svg_overlay: {w}" for w in top.warnings()]
                top = self.shared(top.frame(p.df.sparkSession, params.get("width"), params.get("height")))
            elif "width" in params or "height" in params:
                top = geometry.resize(top, params.get("width"), params.get("height"), "fill", False)
            return composite.over(p, top, params["blend_mode"], params["opacity"], at=(params["x"], params["y"]))
        else:
            self.warn(p, name, params)
            after = RUN[name](p, **params)
        if name in MASKED and "mask" in op:
            after = composite.masked(p, after, self.plane(op["mask"], after))
        if any(e.width * e.height > MOST_PIXELS for e in after.shapes):
            raise ValueError(f"{name}: the result is larger than {MOST_PIXELS} pixels")
        return after

    def chain(self, p: PixelFrame, ops: list) -> PixelFrame:
        for op in ops:
            p = self.operation(p, op)
        return p

    def layers(self, base: PixelFrame, layers: list) -> PixelFrame:
        stack = []
        for layer in layers:
            source = base if layer["source"] == "base" else self.asset(layer["source"]["revision_id"])
            p = self.chain(source, layer["ops"])
            mask = self.plane(layer["mask"], p) if "mask" in layer else None
            stack.append((p, layer["blend_mode"], layer["opacity"], mask))
        return composite.fold(stack)


def plan_of(recipe: dict | str) -> dict:
    """A recipe, as text or tree, or a preset's name, parsed and checked."""
    if isinstance(recipe, str) and not recipe.lstrip().startswith("{"):
        recipe = recipe_of(recipe)
    return validate(parse(recipe))


def execute(recipe: dict | str, relation: DataFrame, width: int | None = None, height: int | None = None, assets: Mapping[str, Any] | None = None, source_format: str = "png", sizes: DataFrame | None = None, shared: int = 1) -> Output:
    """Plan a recipe (or a preset's name) over images given by code values r8, g8, b8, a8 or channels r, g, b, a.

    Either all have one ``width`` and ``height``, or the relation has such columns and images may differ in size; ``sizes`` may then tell the
    sizes there are (width, height), as headers do, so that they need not be read from the pixels. Assets have the same images as the
    relation, or, with ``shared``, one image that is used for all of so many.
    """
    parsed = plan_of(recipe)
    planner = Planner(assets, shared)
    if width is None or height is None:
        p = from_sizes(relation, sizes, first_space(parsed))
    else:
        p = (from_codes if "r8" in relation.columns else from_channels)(relation, width, height, first_space(parsed))
    if parsed.get("layers"):
        p = planner.layers(p, parsed["layers"])
    p = planner.chain(p, parsed["operations"]).to(SRGB)
    encode = next((o for o in parsed["operations"] if o["op"] == "encode"), {})
    out = Output(p, recipe_hash(parsed), encode.get("format", source_format), encode.get("quality"), encode.get("bit_depth", 8), planner.warnings)
    if not encode and source_format not in FORMATS:
        out.format = "jpeg"
        out.warnings.append(f"no encoder for {source_format}: jpeg is written")
    if any(o["op"] == "strip_metadata" and o["scope"] == "gps" for o in parsed["operations"]):
        out.warnings.append("re-encoding drops all EXIF data, not only GPS")
    return out


def preview(recipe: dict) -> dict:
    """The recipe of a preview: not encoded as told but fitted into 768 pixels, as JPEG of quality 80."""
    parsed = parse(recipe)
    kept = [o for o in parsed["operations"] if o["op"] != "encode"]
    tail = [{"op": "resize", "width": 768, "height": 768, "fit": "contain", "without_enlargement": True}, {"op": "encode", "format": "jpeg", "quality": 80}]
    return parsed | {"operations": parse({"operations": [*kept, *tail]})["operations"]}
