"""Kernels on many small tiles give what they give on whole images."""

import numpy as np
import pytest
from test_operators import array, relation

from pixelframe.frame import from_codes
from pixelframe.functions import numeric as N
from pixelframe.operators import filters, geometry, kernels, masks


@pytest.fixture(scope="module")
def image(spark):
    v = np.random.default_rng(8).integers(0, 256, (23, 31, 4))
    return from_codes(relation(spark, v).cache(), 31, 23, "linear")


def test_tiles_change_nothing(image, monkeypatch):
    weights = N.gaussian_weights(3.5)
    assert len(weights) // 2 > filters.WINDOW_RADIUS
    run = {
        "blur": lambda: filters.blur(image, 3.5), "median": lambda: filters.median(image, 2), "rotate": lambda: geometry.rotate(image, 33.0), "full": lambda: geometry.rotate(image, 33.0, "full"),
        "perspective": lambda: geometry.perspective(image, vertical_degrees=20.0, horizontal_degrees=-15.0), "heal": lambda: filters.heal(image, 3, 20, 28, 2, 6, 2.0),
    }
    whole = {k: array(f()) for k, f in run.items()}
    assert np.allclose(whole["blur"], kernels.blurred(array(image), weights), atol=1e-12)
    monkeypatch.setattr(kernels, "TILE", 7)
    monkeypatch.setattr(kernels, "BLOCK", 4)
    for k, f in run.items():
        assert np.allclose(array(f()), whole[k], atol=1e-12), k


def test_share_of_padding_without_an_image(image):
    step, w, h = geometry.perspective_step(31, 23, vertical_degrees=20.0, horizontal_degrees=-15.0)
    assert np.isclose(geometry.padding_share(31, 23, step, w, h), geometry.padding_ratio(image, step, w, h).first().ratio)


def test_inscribed_rectangles_are_the_largest():
    for w, h in ((60, 40), (40, 60), (50, 50), (200, 10)):
        for angle in (1.0, 17.0, 44.9, 45.0, 46.0, 80.0, 133.0):
            s, c = abs(np.sin(np.radians(angle))), abs(np.cos(np.radians(angle)))
            a = np.linspace(0.01, w * c + h * s, 4000)
            b = np.minimum((w - a * c) / s, (h - a * s) / c)
            got = geometry.inscribed(w, h, angle)
            best = np.argmax(a * b)
            clipped = min(int(a[best] + 0.1), w), min(int(b[best] + 0.1), h)
            assert abs(got[0] * got[1] - clipped[0] * clipped[1]) <= 0.1 * got[0] * got[1] + w + h
    assert geometry.rotation_loss(60, 40, 90.0) == 0 and geometry.rotation_loss(60, 40, 10.0) > 0


def test_mask_fields_are_checked(image):
    for kind, fields, code in (
        ("spiral", {}, "invalid_mask_kind"), ("linear_gradient", {"radius": 0.2}, "unexpected_mask_param"), ("color_range", {}, "missing_mask_param"),
        ("linear_gradient", {"start": 0.7, "end": 0.2}, "invalid_mask_param"), ("luminosity_range", {"min": 9, "max": 3}, "invalid_mask_param"), ("radial_gradient", {"feather": 2}, "invalid_mask_param"),
        ("radial_gradient", {"feather": float("nan")}, "invalid_mask_param"),
    ):
        with pytest.raises(masks.MaskError) as e:
            masks.generate(image, kind, **fields)
        assert e.value.code == code
    assert masks.generate(image, "color_range", hue_center=20, hue_width=None).count() == 31 * 23
