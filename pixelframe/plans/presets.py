"""Named recipes. A preset is sugar: hashes are those of its operations."""

from __future__ import annotations

# The presets and their parameters.
PRESETS: dict[str, list[dict]] = {
    "architecture_clean": [
        {"op": "auto_levels", "clip_percent": 0.5, "per_channel": False},
        {"op": "unsharp_mask", "amount": 0.5, "radius": 1.2, "threshold": 2},
        {"op": "adjust", "saturation": -0.05},
    ],
    "bw_high_contrast": [
        {"op": "color_matrix", "matrix": [0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]},
        {"op": "curves", "master": [[0, 0], [64, 36], [192, 222], [255, 255]]},
    ],
    "bw_neutral": [
        {"op": "color_matrix", "matrix": [0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]},
    ],
    "bw_red_filter": [
        {"op": "color_matrix", "matrix": [0.85, 0.1, 0.05, 0.0, 0.0, 0.85, 0.1, 0.05, 0.0, 0.0, 0.85, 0.1, 0.05, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]},
    ],
    "bw_soft": [
        {"op": "color_matrix", "matrix": [0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]},
        {"op": "curves", "master": [[0, 24], [128, 130], [255, 236]]},
    ],
    "cinema_teal_orange": [
        {"op": "hsl", "orange": {"hue": 4, "saturation": 18, "luminance": 4}, "blue": {"hue": -6, "saturation": 20, "luminance": -6}, "aqua": {"hue": -4, "saturation": 14, "luminance": -4}},
        {"op": "adjust", "contrast": 0.08},
    ],
    "duotone_navy_cream": [{"op": "gradient_map", "stops": [{"position": 0.0, "color": "#0a1f3d"}, {"position": 1.0, "color": "#f5ead0"}]}],
    "eyecatch_16_9": [
        {"op": "crop", "aspect_ratio": "16:9", "anchor": "center"},
        {"op": "resize", "width": 1600, "fit": "cover", "without_enlargement": False},
        {"op": "encode", "format": "webp", "quality": 82},
    ],
    "film_cool": [
        {"op": "white_balance", "temperature": -14, "tint": 2},
        {"op": "curves", "master": [[0, 6], [64, 58], [192, 198], [255, 249]]},
        {"op": "grain", "amount": 0.08, "size": 1, "monochrome": True, "seed": 2},
    ],
    "film_grain_strong": [
        {"op": "curves", "master": [[0, 10], [128, 130], [255, 246]]},
        {"op": "grain", "amount": 0.4, "size": 2, "monochrome": True, "seed": 3},
    ],
    "film_soft": [
        {"op": "curves", "master": [[0, 4], [64, 58], [128, 128], [192, 198], [255, 251]]},
        {"op": "color_matrix", "matrix": [0.88189, 0.10728, 0.01083, 0.0, 0.0, 0.03189, 0.95728, 0.01083, 0.0, 0.0, 0.03189, 0.10728, 0.86083, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]},
    ],
    "film_warm": [
        {"op": "white_balance", "temperature": 14, "tint": -2},
        {"op": "curves", "master": [[0, 6], [64, 60], [192, 200], [255, 250]]},
        {"op": "grain", "amount": 0.08, "size": 1, "monochrome": True, "seed": 1},
    ],
    "food_vivid": [
        {"op": "hsl", "orange": {"saturation": 22, "luminance": 4}, "yellow": {"saturation": 18, "luminance": 4}, "red": {"saturation": 12}},
        {"op": "adjust", "contrast": 0.1},
    ],
    "grain_fine": [{"op": "grain", "amount": 0.1, "size": 1, "monochrome": True, "seed": 0}],
    "grayscale": [
        {"op": "color_matrix", "matrix": [0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.2126, 0.7152, 0.0722, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]},
    ],
    "hero_2400": [
        {"op": "resize", "width": 2400, "height": 2400, "fit": "contain", "without_enlargement": True},
        {"op": "encode", "format": "webp", "quality": 85},
    ],
    "instagram_portrait_4_5": [
        {"op": "crop", "aspect_ratio": "4:5", "anchor": "center"},
        {"op": "resize", "width": 1080, "height": 1350, "fit": "cover", "without_enlargement": False},
        {"op": "encode", "format": "webp", "quality": 85},
    ],
    "instagram_square_1080": [
        {"op": "crop", "aspect_ratio": "1:1", "anchor": "center"},
        {"op": "resize", "width": 1080, "height": 1080, "fit": "cover", "without_enlargement": False},
        {"op": "encode", "format": "webp", "quality": 85},
    ],
    "landscape_punch": [{"op": "adjust", "contrast": 0.15, "saturation": 0.18}, {"op": "vignette", "strength": 0.22, "radius": 0.65, "feather": 0.5}],
    "matte_fade": [{"op": "curves", "master": [[0, 28], [128, 132], [255, 238]]}, {"op": "adjust", "saturation": -0.12}],
    "og_1200x630": [
        {"op": "crop", "aspect_ratio": "1200:630", "anchor": "center"},
        {"op": "resize", "width": 1200, "fit": "cover", "without_enlargement": False},
        {"op": "encode", "format": "webp", "quality": 82},
    ],
    "portrait_soft": [
        {"op": "curves", "master": [[0, 12], [128, 130], [255, 244]]},
        {"op": "adjust", "saturation": -0.08},
        {"op": "vignette", "strength": 0.18, "radius": 0.75, "feather": 0.55},
    ],
    "product_clean": [
        {"op": "white_balance", "temperature": 3, "tint": -2},
        {"op": "levels", "in_black": 6, "in_white": 249, "gamma": 1.05},
        {"op": "unsharp_mask", "amount": 0.6, "radius": 1.0, "threshold": 3},
    ],
    "product_white": [
        {"op": "auto_levels", "clip_percent": 0.3, "per_channel": False},
        {"op": "white_balance", "temperature": 2, "tint": -1},
        {"op": "unsharp_mask", "amount": 0.6, "radius": 1.0, "threshold": 3},
    ],
    "sepia": [
        {"op": "color_matrix", "matrix": [0.393, 0.769, 0.189, 0.0, 0.0, 0.349, 0.686, 0.168, 0.0, 0.0, 0.272, 0.534, 0.131, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]},
    ],
    "soft_vignette": [{"op": "vignette", "strength": 0.2, "radius": 0.7, "feather": 0.5}],
    "thumbnail_square": [
        {"op": "crop", "aspect_ratio": "1:1", "anchor": "center"},
        {"op": "resize", "width": 800, "height": 800, "fit": "cover", "without_enlargement": False},
        {"op": "encode", "format": "webp", "quality": 80},
    ],
    "web_optimize": [
        {"op": "resize", "width": 2000, "height": 2000, "fit": "contain", "without_enlargement": True},
        {"op": "encode", "format": "webp", "quality": 80},
    ],
    "x_wide_16_9": [
        {"op": "crop", "aspect_ratio": "16:9", "anchor": "center"},
        {"op": "resize", "width": 1600, "fit": "cover", "without_enlargement": False},
        {"op": "encode", "format": "webp", "quality": 82},
    ],
    "youtube_thumb_1280x720": [
        {"op": "crop", "aspect_ratio": "16:9", "anchor": "center"},
        {"op": "resize", "width": 1280, "height": 720, "fit": "cover", "without_enlargement": False},
        {"op": "encode", "format": "webp", "quality": 85},
    ],
}


def recipe_of(name: str) -> dict:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; known: {', '.join(sorted(PRESETS))}")
    return {"operations": PRESETS[name]}
