"""Value domains of the ride data. Zero-filled counters list every value of a domain."""

# The names, codes and spellings are those of the data.
STATUS = ("PENDING", "ANALYZING", "PROCESSED", "SKIPPED", "ERROR")
ROUTE_COMPARISON = ("EQUIVALENT_ROUTE", "LOCAL_DETOUR", "CORRIDOR_ALTERNATIVE")
RIDE_INTENT = ("COMMUTE", "LEISURE", "UNKNOWN")
EVENT_TYPE = ("AVOIDANCE", "PREFERENCE")
ENRICHMENT_STATUS = ("PENDING", "PROCESSING", "DONE", "ERROR")
TRAFFIC_STATUS = ("ENRICHED", "NO_DETECTOR_MATCH", "NO_SOURCE_FILE", "NO_MEASUREMENT", "LOW_QUALITY", "ERROR")
TRAFFIC_CONDITION = ("UNKNOWN", "LIGHT", "MODERATE", "HEAVY", "CONGESTED")
TRAFFIC_SOURCE = ("NEW_DETECTOR", "OLD_DETECTOR", "OLD_MQ")
WIND_EXPOSURE = ("HEADWIND", "CROSSWIND", "TAILWIND")
FACTOR_TYPE = ("WEATHER", "CONSTRUCTION", "ROAD_CLOSURE", "EVENT", "HAZARD", "INCIDENT", "TRAFFIC")
CYCLEWAY_LOCATION = ("NONE", "LEFT", "RIGHT", "BOTH", "UNKNOWN")
ENRICHMENT_FILTER = ("TRAFFIC_ENRICHED", "WEATHER_ENRICHED", "OHSOME_ENRICHED", "TRAFFIC_MEASURED")

CLOSURE_SEVERITY = {"keine Sperrung": "NO_CLOSURE", "Vollsperrung": "FULL_CLOSURE", "Fahrtrichtungssperrung": "DIRECTIONAL_CLOSURE"}
CLOSURE_FACTOR = {
    "Baustelle": "CONSTRUCTION",
    "Bauarbeiten": "CONSTRUCTION",
    "Sperrung": "ROAD_CLOSURE",
    "Störung": "EVENT",
    "Gefahr": "HAZARD",
    "Unfall": "INCIDENT",
}
CYCLEWAY_TYPE = {
    "track": "TRACK",
    "lane": "LANE",
    "shared_lane": "SHARED_LANE",
    "share_busway": "SHARE_BUSWAY",
    "no": "NO",
    "separate": "SEPARATE",
    "crossing": "CROSSING",
    "opposite": "NO",
    "opposite_lane": "LANE",
    "opposite_track": "TRACK",
}
BIKE_TYPE = ("NOT_CHOSEN", "CITY_TREKKING_BIKE", "ROAD_RACING_BIKE", "E_BIKE", "RECUMBENT_BICYCLE", "FREIGHT_BICYCLE", "TANDEM_BICYCLE", "MOUNTAIN_BIKE", "OTHER")
PHONE_LOCATION = ("POCKET", "HANDLEBAR", "JACKET_POCKET", "HAND", "BASKET", "BAG", "OTHER")
INCIDENT_TYPE = {0: "NOTHING", 1: "CLOSE_PASS", 2: "PULLING_IN_OUT", 3: "NEAR_HOOK", 4: "HEAD_ON", 5: "TAILGATING", 6: "NEAR_DOORING", 7: "DODGING", 8: "OTHER", -5: "DUMMY"}
PARTICIPANT_TYPE = {1: "BUS", 2: "CYCLIST", 3: "PEDESTRIAN", 4: "DELIVERY_VAN", 5: "TRUCK", 6: "MOTORCYCLE", 7: "CAR", 8: "TAXI", 9: "OTHER", 10: "SCOOTER"}
COMPASS = {"nord": 0.0, "nordost": 45.0, "ost": 90.0, "südost": 135.0, "suedost": 135.0, "süd": 180.0, "sued": 180.0, "südwest": 225.0, "suedwest": 225.0, "west": 270.0, "nordwest": 315.0}
