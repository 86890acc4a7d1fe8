"""Drawings against shapes that are known."""

import numpy as np
import pytest

from pixelframe.sources.svg import SvgError, color_of, path_of, rasterise, size_of


def draw(inner, w=40, h=40, more=""):
    out, warnings = rasterise(f'<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="{w}" height="{h}" {more}>{inner}</svg>')
    return out, warnings


def area(inner, **k):
    return draw(inner, **k)[0][..., 3].sum()


def test_areas_of_shapes():
    for inner, want in (
        ('<rect x="5" y="6" width="20" height="10"/>', 200),
        ('<rect x="5" y="6" width="20" height="10" rx="5"/>', 200 - (4 - np.pi) * 25),
        ('<circle cx="20" cy="20" r="12"/>', np.pi * 144),
        ('<ellipse cx="20" cy="20" rx="15" ry="6"/>', np.pi * 90),
        ('<polygon points="0,0 40,0 0,40"/>', 800),
        ('<path d="M10 10h20v20H10z"/>', 400),
        ('<path d="M10,20a10,10 0 1 0 20,0a10 10 0 1 0-20 0"/>', np.pi * 100),
        ('<path d="M0 40C0 40 20 0 40 40z"/>', 480),  # the integral of 120 t^2 (1 - t) (120 t - 60 t^2)
        ('<path d="M0 40Q20 0 40 40T80 40z" />', 2 / 3 * 40 * 20),
        ('<line x1="5" y1="20" x2="35" y2="20" stroke="red" stroke-width="4"/>', 120),
        ('<line x1="10" y1="20" x2="30" y2="20" stroke="red" stroke-width="6" stroke-linecap="square"/>', 26 * 6),
        ('<line x1="10" y1="20" x2="30" y2="20" stroke="red" stroke-width="6" stroke-linecap="round"/>', 120 + np.pi * 9),
        ('<rect x="10" y="10" width="20" height="20" fill="none" stroke="blue" stroke-width="2"/>', 22 * 22 - 18 * 18),
        ('<rect x="10" y="10" width="20" height="20" fill="none" stroke="blue" stroke-width="2" stroke-linejoin="bevel"/>', 22 * 22 - 18 * 18 - 4 * 0.5),
        ('<path d="M0 0H30V30H0zM10 10H20V20H10z" fill-rule="evenodd"/>', 800),
        ('<path d="M0 0H30V30H0zM10 10H20V20H10z"/>', 900),
        ('<g transform="translate(20 20) rotate(45) scale(.5)"><rect x="-20" y="-20" width="40" height="40"/></g>', 400),
        ('<defs><rect id="r" width="10" height="10"/></defs><use xlink:href="#r" x="3" y="4"/><use href="#r" x="20" y="20"/>', 200),
    ):
        assert area(inner) == pytest.approx(want, rel=0.02, abs=2), inner


def test_paints():
    out, _ = draw('<rect width="40" height="40" fill="rgb(255,0,0)" fill-opacity="0.5"/><g fill="lime" opacity=".5"><rect x="20" width="20" height="40"/></g>')
    assert np.allclose(out[5, 5], [1, 0, 0, 0.5]) and np.allclose(out[5, 30], [1 / 3, 2 / 3, 0, 0.75])
    out, _ = draw('<linearGradient id="g"><stop offset="0" stop-color="black"/><stop offset="100%" stop-color="#fff"/></linearGradient><rect width="40" height="40" fill="url(#g)"/>')
    assert np.allclose(out[7, :, 0], (np.arange(40) + 0.5) / 40)
    out, _ = draw('<radialGradient id="g" gradientUnits="userSpaceOnUse" cx="20" cy="20" r="20"><stop offset="0" style="stop-color:#f00"/><stop offset="1" stop-color="#00f" stop-opacity="0"/></radialGradient><rect width="40" height="40" style="fill:url(#g)"/>')
    far = np.hypot(0.5, 10.5) / 20
    assert np.allclose(out[20, 30], [1 - far, 0, far, 1 - far])
    assert color_of("#abc") == color_of("#aabbcc") and color_of("rgb(10%, 20%, 30%)") == pytest.approx((0.1, 0.2, 0.3, 1.0)) and color_of("none") is None


def test_sizes_views_and_what_is_not_drawn():
    out, _ = draw('<rect width="2" height="1"/>', 40, 20, 'viewBox="0 0 4 2"')
    assert out.shape == (20, 40, 4) and out[..., 3].sum() == 200 and out[0, 0, 3] == 1
    assert size_of('<svg width="3" height="4px"/>') == (3, 4) and size_of('<svg viewBox="0 0 7 9"/>') == (7, 9) and size_of("<svg/>") == size_of("<svg") == (0, 0)
    _, warnings = draw('<text>no</text><image/><rect width="4" height="4" filter="url(#f)"/><rect width="4" height="4" fill="url(#none)"/>')
    assert len(warnings) == 4
    for bad in ("<svg", "<svg/>", '<!DOCTYPE x [<!ENTITY a "b">]><svg width="1" height="1"/>', '<svg width="99999" height="9"/>'):
        with pytest.raises(SvgError):
            rasterise(bad)
    assert path_of("M1 1 L2 2 junk") == path_of("M1 1 2 2") and path_of("") == []
