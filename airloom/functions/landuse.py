"""Surface, function and building classes from map tags, and what buildings are estimated to hold."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag values of the building classes.
BUILDINGS = {
    "apartments": ["apartments", "residential", "block", "dorm"],
    "farm": ["farm"],
    "hotel": ["hotel"],
    "house": ["house", "houseboat", "bungalow", "static_caravan", "shed", "hut", "detached", "cabin"],
    "commercial": ["commercial"],
    "office": ["office"],
    "industrial": ["industrial", "digester"],
    "retail": ["retail", "kiosk", "shop"],
    "warehouse": ["warehouse", "hangar"],
    "religious": ["religious", "cathedral", "chapel", "church", "mosque", "temple", "synagogue", "shrine"],
    "public": ["civic", "public"],
    "hospital": ["hospital"],
    "education": ["kindergarten", "school", "university"],
    "leisure": ["stadium", "grandstand", "riding_hall", "conservatory"],
    "small utility": ["garage", "garages", "garbage_shed", "roof", "terrace", "carport", "bunker"],
    "undefined": ["yes"],
}
#: Building class of a functional land use.
BY_ZONE = {"industrial": "industrial", "commercial": "commercial", "farmland": "farm", "farmyard": "farm", "school": "education", "railway": "transport", "religious": "religious"}
#: Three sizes in square metres, the floors above each and below the last, and the greatest area that counts for population.
SPECS = {
    "apartments": ([1000, 500, 200], [6, 5, 4, 3], 1500),
    "farm": ([1000, 500, 200], [3, 2, 2, 2], 1000),
    "house": ([240, 160, 110], [2, 2, 2, 1], 100),
    "commercial": ([3000, 1500, 500], [7, 7, 6, 3], 0),
    "industrial": ([3000, 1500, 500], [5, 4, 3, 3], 0),
    "warehouse": ([5000, 2000, 1000], [3, 3, 3, 2], 0),
    "education": ([2000, 1200, 200], [7, 6, 4, 2], 500),
    "small utility": ([300, 100, 70], [2, 1, 1, 1], 0),
}
OTHER_SPECS = ([2000, 1200, 200], [7, 6, 4, 2], 0)
#: Metres in a floor, people in a house, area of a floor for one person, areas that part utilities, houses and halls.
FLOOR_M, PER_HOUSE, PER_PERSON_M2 = 3.5, 2.2, 100.0
UTILITY_M2, HOUSE_M2 = 51, 280


def by_value(value: Column, classes: dict) -> Column:
    """The class whose list has the value."""
    return F.element_at(F.create_map(*[F.lit(x) for name, values in classes.items() for v in values for x in (v, name)]), value)


def surface(tags: Column) -> Column:
    """``key:value`` of the first key present: building, highway, landuse, natural."""
    return F.coalesce(*[F.concat(F.lit(k + ":"), F.try_element_at(tags, F.lit(k))) for k in ("building", "highway", "landuse", "natural")])


def tagged_building(tags: Column) -> Column:
    """Class by tags; null if it is no building. ``building=yes`` looks at office, tourism, amenity and leisure, in this order."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    own = F.coalesce(tag("building"), tag("building:part"))
    more = F.coalesce(tag("amenity"), tag("leisure"))
    said = F.when(tag("office").isNotNull(), "office").when(tag("tourism") == "hotel", "hotel").when(tag("tourism").isNotNull(), "public").otherwise(F.coalesce(by_value(more, BUILDINGS), F.lit("undefined")))
    return F.when(own == "yes", said).otherwise(by_value(own, BUILDINGS))


def estimated_building(zone: Column, area: Column, around: Column) -> Column:
    """Class of a building without one: by its zone, then by its perimeter while it is small, then by area; large ones of odd shape are commercial."""
    of_zone = F.element_at(F.create_map(*[F.lit(x) for kv in BY_ZONE.items() for x in kv]), zone)
    industrial = F.when(area > 5000, "warehouse").when(area > UTILITY_M2, "industrial").otherwise("small utility")
    commercial = F.when(area > UTILITY_M2, "commercial").otherwise("small utility")
    odd = around / 4 > 1.7 * F.sqrt(area)
    by_size = F.when(around < 30, "small utility").when(around < 64, "house").when(area < 2000, "apartments").when((area < 5000) | odd, "commercial").otherwise("warehouse")
    return F.when(of_zone == "industrial", industrial).when(of_zone == "commercial", commercial).otherwise(F.coalesce(of_zone, by_size))


def by_class(kind: Column, pick) -> Column:
    """A column for each class of SPECS; ``pick(sizes, floors, most)``."""
    out = pick(*OTHER_SPECS)
    for name, spec in SPECS.items():
        out = F.when(kind == name, pick(*spec)).otherwise(out)
    return out


def floors(kind: Column, area: Column) -> Column:
    return by_class(kind, lambda sizes, n, most: F.when(area > sizes[0], n[0]).when(area > sizes[1], n[1]).when(area > sizes[2], n[2]).otherwise(n[3]))


def population(kind: Column, area: Column) -> Column:
    """People in a building: 2.2 in a house, else one for each 100 square metres of floor, whole numbers."""
    most = by_class(kind, lambda sizes, n, most: F.lit(float(most)))
    return F.when(kind == "house", PER_HOUSE).otherwise(F.floor(floors(kind, area) * F.least(area, most) / PER_PERSON_M2).cast("double"))


def wood_burning(kind: Column, area: Column, people_per_km2: Column) -> Column:
    """Wood burnt per square metre: small dwellings of up to 12 m, more for those that are clearly houses and where few people live."""
    dwelling = kind.isin("house", "farm", "farm aux", "apartments", "terrace") & area.between(UTILITY_M2, 350) & (floors(kind, area) * FLOOR_M <= 12)
    clear = F.when((area < 0.75 * HOUSE_M2) & (area > 0.4 * HOUSE_M2), 1.2).otherwise(1.0)
    sparse = F.when(people_per_km2 < 1200, 1.3).when(people_per_km2 < 1600, 1.2).when(people_per_km2 < 2000, 1.1).when(people_per_km2 > 6000, 0.7).when(people_per_km2 > 4000, 0.8).otherwise(1.0)
    return F.when(dwelling, 2.17 * clear * F.coalesce(sparse, F.lit(1.0)) / area).otherwise(0.0)
