import pytest

from pixelframe.plans.catalog import CATEGORY_OF, explain_operation
from pixelframe.plans.compile import preview
from pixelframe.plans.presets import PRESETS, recipe_of
from pixelframe.plans.recipe import MASKED, OPS, RecipeError, canonical, parse, recipe_hash, validate

# Recipes whose hashes are pinned.
FULL = """{"operations":[{"op":"auto_orient"},{"op":"rotate","angle_degrees":-1.8,"crop":"largest_inscribed_rect"},{"op":"crop","aspect_ratio":"16:9","anchor":"center"},
{"op":"resize","width":800,"fit":"cover"},{"op":"adjust","brightness":0.05,"contrast":0.02,"saturation":0.03,"sharpness":0.2},{"op":"encode","format":"jpeg","quality":85}]}"""
HEAL = """{"operations":[{"op":"resize","width":320,"height":240,"fit":"cover"},{"op":"clone","src_x":80,"src_y":60,"dest_x":220,"dest_y":170,"radius":24,"feather_px":6.0},
{"op":"heal","src_x":120,"src_y":200,"dest_x":60,"dest_y":110,"radius":18,"feather_px":4.0},{"op":"encode","format":"jpeg","quality":85}]}"""


def test_pinned_hashes():
    assert recipe_hash(FULL) == "884ea169e1027cf26d9140f6d2f7543904b2ca344667640f87820f528eaa175d"
    assert recipe_hash(HEAL) == "d7c217f735ad6b9b88cb9a927bd14e4d452c87bab669ba9c2c689ff5c3d6f283"


def test_hash_ignores_order_and_defaults():
    a = {"operations": [{"op": "vignette", "strength": 0.2}]}
    b = {"operations": [{"feather": 0.5, "radius": 0.7000000001, "strength": 0.2, "op": "vignette"}]}
    assert recipe_hash(a) == recipe_hash(b)
    assert canonical(1.0) == "1.0" and canonical(1e-6) == "1e-6" and canonical(0.30000000000000004) == "0.3"


def test_all_operations():
    assert len(OPS) == 27 and len(MASKED) == 14 and set(CATEGORY_OF) == set(OPS) and len(PRESETS) == 30
    for name in OPS:
        assert explain_operation(name)["op"] == name
    with pytest.raises(KeyError, match="did you mean"):
        explain_operation("cur")
    for name in PRESETS:
        validate(parse(recipe_of(name)))


@pytest.mark.parametrize(
    "op",
    [
        {"op": "rotate", "angle_degrees": 400.0}, {"op": "rotate", "angle_degrees": float("nan")}, {"op": "crop"}, {"op": "crop", "aspect_ratio": "0:1"},
        {"op": "crop", "aspect_ratio": "1:1", "coordinate_space": "source"}, {"op": "resize"}, {"op": "resize", "width": 0}, {"op": "adjust", "contrast": 2},
        {"op": "adjust", "unknown": 1}, {"op": "color_matrix", "matrix": [1.0] * 19}, {"op": "curves"}, {"op": "curves", "master": [[5, 0], [5, 1]]},
        {"op": "levels", "in_black": 9, "in_white": 9}, {"op": "blur", "sigma": 0.0}, {"op": "median", "radius": 17}, {"op": "lut", "lut_revision_id": "x"}, {"op": "hsl"},
        {"op": "convolve", "kernel": [1.0] * 9, "size": 5}, {"op": "perspective"}, {"op": "perspective", "quad": [[0, 0], [0, 9], [9, 9], [9, 0]]},
        {"op": "gradient_map", "stops": [{"position": 0.0, "color": "#fff"}]}, {"op": "encode", "format": "jpeg", "bit_depth": 16}, {"op": "flip"}, {"op": "nothing"},
        {"op": "blur", "sigma": 1.0, "mask": {"revision_id": "rev_a", "feather_px": 300.0}}, {"op": "vignette", "strength": True}, {"op": "resize", "width": 2.5},
    ],
)
def test_refused(op):
    with pytest.raises(RecipeError):
        validate(parse({"operations": [op]}))


def test_layers_rules():
    base = {"source": "base", "ops": []}
    validate(parse({"operations": [], "layers": [base, {**base, "blend_mode": "hue", "opacity": 0.5}]}))
    for layers in ([], [{**base, "opacity": 0.5}], [{"source": {"revision_id": "x"}}], [{**base, "ops": [{"op": "encode", "format": "png"}]}], [base, {**base, "blend_mode": "?"}]):
        with pytest.raises(RecipeError):
            validate(parse({"operations": [], "layers": layers}))
    with pytest.raises(RecipeError):
        validate(parse({"operations": []}))


def test_encode_comes_last_and_once():
    encode = {"op": "encode", "format": "png"}
    with pytest.raises(RecipeError):
        validate(parse({"operations": [encode, {"op": "auto_orient"}]}))
    assert [o["op"] for o in preview({"operations": [{"op": "vignette", "strength": 0.1}, encode]})["operations"]] == ["vignette", "resize", "encode"]


def test_errors_tell_where_and_how_to_go_on():
    for recipe, index, op, layer in (
        ({"operations": [{"op": "flip", "direction": "horizontal"}, {"op": "vignette", "strength": 7.0}]}, 1, "vignette", None),
        ({"operations": [], "layers": [{"source": "base"}, {"source": "base", "opacity": 2.0}]}, None, None, 1),
        ({"operations": []}, None, None, None),
    ):
        with pytest.raises(RecipeError) as e:
            validate(parse(recipe))
        told = e.value.details()
        assert (told["operation_index"], told["op"], told["layer_index"]) == (index, op, layer) and told["recovery"]


def test_errors_carry_their_place_and_kind_as_fields():
    layer = {"source": "base", "ops": [{"op": "auto_orient"}, {"op": "blur", "sigma": 0.0}]}
    for recipe, fields, words, recovery in (
        ({"operations": [{"op": "lut", "lut_revision_id": "missing unknown operation operations[9] (flip)"}]}, (0, "lut", None), "operations[0] (lut): ", "explain_operation('lut')"),
        ({"operations": [], "layers": [{"source": "base"}, layer]}, (1, "blur", 1), "layers[1].ops[1] (blur): sigma", "explain_operation('blur')"),
        ({"operations": [{"op": "flip"}]}, (0, "flip", None), "missing field 'direction'", "Add what is missing"),
        ({"operations": [{"op": "spin"}]}, (0, None, None), "operations[0]: unknown operation 'spin'", "list_operations"),
        ({"operations": []}, (None, None, None), "needs operations or layers", "Add what is missing"),
        ({"operations": [], "layers": []}, (None, None, None), "the list of layers is empty", "Add what is missing"),
        ({"operations": [], "layers": [{"source": 3}]}, (None, None, 0), "layers[0] (source): ", "Correct the named field"),
        ({"operations": [{"op": "gradient_map", "stops": [{"position": "x", "color": "#fff"}]}]}, (0, "gradient_map", None), "operations[0] (gradient_map).stops", "explain_operation"),
    ):
        with pytest.raises(RecipeError) as e:
            validate(parse(recipe))
        assert (e.value.operation_index, e.value.op, e.value.layer_index) == fields
        assert words in str(e.value) and recovery in e.value.recovery


def test_every_operation_is_explained():
    from pixelframe.plans.catalog import ABOUT

    assert set(ABOUT) == set(OPS) and all(explain_operation(o)["about"] for o in OPS)
