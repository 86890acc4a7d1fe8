"""What operations there are: a small table, and explanations with near matches."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession

from .recipe import MASKED, OMITTED, OPS, REQUIRED

CATEGORIES = {
    "geometry": "auto_orient rotate perspective crop resize flip",
    "color": "adjust color_matrix curves levels lut white_balance hsl gradient_map auto_levels",
    "filter": "blur median unsharp_mask convolve clone heal svg_overlay vignette grain pixelate",
    "output": "encode strip_metadata",
}
CATEGORY_OF = {op: c for c, ops in CATEGORIES.items() for op in ops.split()}


#: What each operation does, in a sentence or two.
ABOUT = {
    "auto_orient": "Says that the image is to stand the way up that EXIF asks for. Scans do that anyway, so it changes nothing.",
    "rotate": "Turns clockwise. Quarter turns move pixels; other angles resample and keep the largest upright rectangle or the whole canvas.",
    "perspective": "Maps a quadrilateral to a rectangle, or tilts the image by keystone angles; places without a source are padded.",
    "crop": "Cuts to an aspect ratio at an anchor, pads to one, or cuts a rectangle given in current or source coordinates.",
    "resize": "Scales with a Lanczos filter in linear light so that the image covers, fits into or fills a size.",
    "flip": "Mirrors along the horizontal or the vertical.",
    "adjust": "Brightness, contrast, saturation and sharpness, each around 0.",
    "color_matrix": "Each channel as a weighted sum of r, g, b, a and 1.",
    "curves": "Tone curves through control points, for all channels and for single ones; monotone between the points.",
    "levels": "Stretches between black and white points with a gamma.",
    "lut": "Looks colours up in an imported .cube table, by tetrahedra in three dimensions, and mixes by strength.",
    "white_balance": "Warmer or colder by temperature, greener or redder by tint; gains in linear light.",
    "hsl": "Hue, saturation and luminance of eight bands of colour, mixed between neighbouring bands.",
    "gradient_map": "Replaces each luma by the colour at its place between stops.",
    "auto_levels": "Stretches between the bins at which a clipped share of the pixels is reached, by luma or by channel.",
    "blur": "A Gaussian in linear light on premultiplied colour.",
    "median": "The middle value of each channel in a square.",
    "unsharp_mask": "Adds the difference to a blurred image where it exceeds a threshold.",
    "convolve": "A kernel of 3, 5, 7 or 9 a side with a divisor and an offset.",
    "clone": "Copies a disc from elsewhere in the image, with a soft edge.",
    "heal": "Lays the detail of one disc over the ground of another.",
    "svg_overlay": "Stamps an imported drawing at a place, with a blend mode and an opacity.",
    "vignette": "Darkens towards the corners from a radius on.",
    "grain": "Adds noise that follows from the seed and the place alone.",
    "pixelate": "Replaces blocks, of the image or of a region, by their means.",
    "encode": "The file's format, quality and depth; only as the last operation.",
    "strip_metadata": "Says which metadata the file must not have; EXIF never survives, a colour profile does unless all is stripped.",
}


def list_operations(spark: SparkSession) -> DataFrame:
    rows = [(op, CATEGORY_OF[op], len(params), op in MASKED) for op, params in OPS.items()]
    return spark.createDataFrame(sorted(rows), "op string, category string, n_params int, maskable boolean")


def explain_operation(name: str) -> dict:
    """Parameters, kinds and defaults of an operation; a KeyError names similar ones."""
    if name == "layers":
        return {"op": "layers", "category": "composite", "params": {k: {"kind": k} for k in ("source", "ops", "mask", "blend_mode", "opacity")}}
    if name not in OPS:
        near = [o for o in OPS if o.startswith(name) or name in o] or difflib.get_close_matches(name, OPS)
        raise KeyError(f"unknown operation {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    told = {k: {"kind": v[0], "required": v[1] is REQUIRED} | ({"default": v[1]} if v[1] not in (REQUIRED, OMITTED) else {}) for k, v in OPS[name].items()}
    return {"op": name, "category": CATEGORY_OF[name], "about": ABOUT[name], "maskable": name in MASKED, "params": told}
