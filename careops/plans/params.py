"""Parameter sets for the compositions.

``WAREHOUSE`` holds the literal values of the original hand-run analyses
(dates, geographies, category lists) for use on the production tables.
``TESTDATA`` re-targets the same analyses at the shared test tables, whose
orders span 1995–2001 and whose contact events span January 2024.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Menu categories whose items are flagged as alcohol by
# mistake (true positives exclude them).  Spacing is significant.
MISFLAGGED_ALCOHOL_CATEGORIES = (
    "Desserts",
    "Appetisers",
    "Battered Fish",
    "Side Dishes",
    "Tandoori Dishes",
    '10" Pizzas',
    "Extras",
    "Garlic  ",
    "Add Cheese to Burger  ",
    "Sausage  ",
    "Cloudy Lemonade - Can",
    "Baked Beans",
    "Haddock (Large) (Grilled)",
    "Beef In A Spicy Green Tomatillo Sauce",
    "Lemon & Herb  ",
    "No Side  ",
    "Pineapple Pop",
    "Mild Heat  ",
    "No Chips  ",
    "Add Onion Rings to Burger  ",
    "Thick",
    "Garlic Mayo ",
    "French Dressing  ",
    "Curry Sauce",
    "Tomato Ketchup  ",
    "BBQ Sauce  ",
    "Relish  ",
    "Add Smoked Bacon to Burger  ",
    "Cream Soda - Can",
    "Mediterranean Dressing  ",
    "Plaice (Grilled)",
    "Gravy",
    "Lemon",
    "No Heat ",
    "Very Hot ",
    "Cod (Standard) (Grilled)",
    "Balsamic Dressing  ",
    "Free Cod & Chips",
    "No Dressing  ",
    "Hot  ",
    "Haddock",
    "The Whole Shabang (All 3 Flavours!)    ",
    "Lemon Sole (Grilled)",
    "Mushy Peas",
    "Cod",
    "Rajun Cajun  ",
    "Cod (Large) (Grilled)",
    "Mayo  ",
    "Mushy Peas ",
    "No Sauce  ",
    "Vegetarian",
)

# Categories whose unflagged items are not alcohol even when
# the category holds a flagged item, and the excluded category prefix.
NOT_ALCOHOL_CATEGORIES = (
    "Mods",
    "Drinks",
    "Other",
    "Mixers",
    "Premium",
    "Bread Choice",
    "Crepes",
    "Magnum Tubs",
    "Cakes",
    "I Like it Fried!",
    "Modifiers ",
    "Ben & Jerry Tubs",
    "Craft Beers",
    "Beer ",
    " NEW! ALCOHOLIC DRINKS",
    "Red Wines - Argentina",
    "Sides",
    "Chocies for Bundles",
    "Topping",
    "Kids _Mods",
    "Soft Drinks",
    "Non-Dairy",
    "Waffles",
    "Smoothies",
    "Extra Filling",
    "Snacks_MOD",
    "MODS",
    "Express Café Menu",
)
NOT_ALCOHOL_PREFIX = "Ben & Jerry"


@dataclass(frozen=True)
class Params:
    # first-order cohorts
    day_window: tuple[str, str]
    week_window: tuple[str, str]
    week_offset: int
    core_zone_week_offset: int
    geo_countries: tuple[str, ...]
    geo_cities: tuple[str, ...]
    # contacts / self-serve claims matched to the cohorts
    contact_window: tuple[str, str]
    day_contact_window: tuple[str, str]  # of the day-cohort analysis
    horizon_weeks: int
    # extracts
    extract_window: tuple[str, str]
    extract_excluded_dates: tuple[str, ...]
    csat_window: tuple[str, str]
    csat_excluded_countries: tuple[str, ...]
    claims_as_of: str | None
    claims_days: int
    claims_amount: int
    # alcohol
    misflagged_categories: tuple[str, ...] = MISFLAGGED_ALCOHOL_CATEGORIES
    not_alcohol_categories: tuple[str, ...] = NOT_ALCOHOL_CATEGORIES
    not_alcohol_prefix: str = NOT_ALCOHOL_PREFIX
    lob: str = "Customer"
    extras: dict = field(default_factory=dict)


# The original analyses' windows, week offsets, geographies,
# excluded dates and countries, claim look-back and amount (each analysis
# used its cohort window for its contacts too).
WAREHOUSE = Params(
    day_window=("2018-06-01", "2018-06-30"),
    week_window=("2018-04-02", "2018-07-01"),
    week_offset=13,
    core_zone_week_offset=12,
    geo_countries=("Netherlands",),
    geo_cities=("Ghent", "Leuven", "Antwerp", "Brugge", "Hasselt", "Knokke", "Mechelen", "Kortrijk"),
    contact_window=("2018-04-02", "2018-07-01"),
    day_contact_window=("2018-06-01", "2018-06-30"),
    horizon_weeks=12,
    extract_window=("2018-07-01", "2018-10-01"),
    extract_excluded_dates=("2018-09-16", "2018-09-26"),
    csat_window=("2018-09-01", "2018-09-30"),
    csat_excluded_countries=("UK", "Ireland"),
    claims_as_of=None,
    claims_days=90,
    claims_amount=15,
)

# The same analyses on the shared test tables.
TESTDATA = Params(
    day_window=("1995-01-02 00:00:00", "1995-01-31 00:00:00"),
    week_window=("1995-01-02 00:00:00", "1995-04-03 00:00:00"),
    week_offset=1,
    core_zone_week_offset=2,
    geo_countries=("NATION_3",),
    geo_cities=("BUILDING",),
    contact_window=("2024-01-01 00:00:00", "2024-01-31 00:00:00"),
    day_contact_window=("2024-01-04 00:00:00", "2024-01-23 00:00:00"),
    horizon_weeks=12,
    extract_window=("2024-01-01 00:00:00", "2024-01-31 00:00:00"),
    extract_excluded_dates=("2024-01-16",),
    csat_window=("2024-01-01 00:00:00", "2024-01-31 00:00:00"),
    csat_excluded_countries=("NATION_0", "NATION_1"),
    claims_as_of="2024-01-31",
    claims_days=21,
    claims_amount=15,
    misflagged_categories=("blue anvil",),
    not_alcohol_categories=("small ring",),
    not_alcohol_prefix="red",
)
