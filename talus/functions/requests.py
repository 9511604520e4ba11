"""What a client asks for, checked and brought to the forms that filters take; ValueError says what is wrong."""

from __future__ import annotations


def number(text: object, name: str) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be numeric") from None


def bounds(text: str | None, name: str) -> tuple[float | None, float | None]:
    """(low, high) of "low,high"; a blank side is open."""
    if not text:
        return None, None
    sides = text.split(",")
    if len(sides) != 2:
        raise ValueError(f"{name} must be 'min,max'")
    low, high = (number(s, name) if s.strip() else None for s in sides)
    if low is not None and high is not None and low > high:
        raise ValueError(f"{name} min exceeds max")
    return low, high


def box(text: str | None) -> tuple[float, float, float, float] | None:
    """(min_lng, min_lat, max_lng, max_lat)."""
    if not text:
        return None
    sides = [number(s, "bbox values") for s in text.split(",")]
    if len(sides) != 4:
        raise ValueError("bbox must be 'minLng,minLat,maxLng,maxLat'")
    west, south, east, north = sides
    if max(abs(west), abs(east)) > 180 or max(abs(south), abs(north)) > 90:
        raise ValueError("bbox out of range")
    if west > east or south > north:
        raise ValueError("bbox min exceeds max")
    return west, south, east, north


def words(text: str | None) -> list[str]:
    """Lower-case entries of a comma-separated list; blank ones don't count."""
    return [w.strip().lower() for w in (text or "").split(",") if w.strip()]


def place(lat: object, lng: object) -> tuple[float, float]:
    """A latitude and longitude; zero is a place."""
    if lat is None or lng is None:
        raise ValueError("lat and lng required")
    lat, lng = number(lat, "lat and lng"), number(lng, "lat and lng")
    if not (abs(lat) <= 90 and abs(lng) <= 180):
        raise ValueError("lat/lng out of range")
    return lat, lng


def radius(asked: object, default: float, most: float, least: float = 0.1) -> float:
    return max(least, min(number(default if asked is None else asked, "radius"), most))
