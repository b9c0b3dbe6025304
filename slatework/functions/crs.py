"""Coordinates of common reference systems as degrees and back, over numpy arrays."""

from __future__ import annotations

import math

import numpy as np

# WGS84 ellipsoid, scale and offsets of the transverse Mercator zones, radius of the web map.
A, F, K0, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10_000_000.0
_N = F / (2 - F)
#: Radius of the rectifying sphere, and the series of the transverse Mercator projection in the third flattening, to the sixth order.
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Coefficients of those series (forward, inverse), by power of the third flattening.
_FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600), (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840), (0, 0, 0, 0, 0, 212378941 / 319334400),
)
_INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600), (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680), (0, 0, 0, 0, 0, 20648693 / 638668800),
)
_ALPHA = [sum(c * _N ** (i + 1) for i, c in enumerate(row)) for row in _FORWARD]
_BETA = [sum(c * _N ** (i + 1) for i, c in enumerate(row)) for row in _INVERSE]
_E = math.sqrt(F * (2 - F))


def utm_zone(epsg: int) -> tuple[float, bool] | None:
    """Central meridian and hemisphere (north) of an EPSG code of the zones, else None."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return -183.0 + 6 * (epsg % 100), epsg < 32700
    return None


def known(epsg: int) -> bool:
    """Whether ``to_degrees`` and ``from_degrees`` know the system."""
    return epsg in (4326, 3857) or utm_zone(epsg) is not None


def to_degrees(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of coordinates in EPSG 4326, 3857 or a UTM zone (326xx, 327xx). Other codes raise ValueError."""
    if epsg == 4326:
        return np.asarray(x, float), np.asarray(y, float)
    if epsg == 3857:
        return np.degrees(np.asarray(x) / A), np.degrees(2 * np.arctan(np.exp(np.asarray(y) / A)) - math.pi / 2)
    zone = utm_zone(epsg)
    if zone is None:
        raise ValueError(f"EPSG:{epsg} is not known")
    xi = (np.asarray(y, float) - (0.0 if zone[1] else FALSE_NORTH)) / (K0 * _R)
    eta = (np.asarray(x, float) - FALSE_EAST) / (K0 * _R)
    inner_xi = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    inner_eta = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    conformal = np.sin(inner_xi) / np.sqrt(np.sinh(inner_eta) ** 2 + np.cos(inner_xi) ** 2)
    tau = goal = conformal
    for _ in range(6):  # from the conformal to the geographic latitude
        sigma = np.sinh(_E * np.arctanh(_E * tau / np.sqrt(1 + tau * tau)))
        now = tau * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + tau * tau)
        tau = tau + (goal - now) / np.sqrt(1 + now * now) * (1 + (1 - _E**2) * tau * tau) / ((1 - _E**2) * np.sqrt(1 + tau * tau))
    return zone[0] + np.degrees(np.arctan2(np.sinh(inner_eta), np.cos(inner_xi))), np.degrees(np.arctan(tau))


def from_degrees(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of longitude and latitude in EPSG 4326, 3857 or a UTM zone. Other codes raise ValueError."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return np.radians(lon) * A, np.log(np.tan(math.pi / 4 + np.radians(lat) / 2)) * A
    zone = utm_zone(epsg)
    if zone is None:
        raise ValueError(f"EPSG:{epsg} is not known")
    tau, away = np.tan(np.radians(lat)), np.radians(lon - zone[0])
    sigma = np.sinh(_E * np.arctanh(_E * tau / np.sqrt(1 + tau * tau)))
    conformal = tau * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + tau * tau)
    xi, eta = np.arctan2(conformal, np.cos(away)), np.arcsinh(np.sin(away) / np.sqrt(conformal**2 + np.cos(away) ** 2))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return K0 * _R * x + FALSE_EAST, K0 * _R * y + (0.0 if zone[1] else FALSE_NORTH)
