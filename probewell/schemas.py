"""Schemas of the tables that the readers load and the operators take."""

ACCESS_LOG = "httpRequest struct<requestUrl string>"
INSTITUTION_STRUCT = "struct<id bigint, name string, homeUrl string, description string, rorId string, location struct<countryCode string, countryName string>>"
RESOURCE_STRUCT = f"struct<id bigint, name string, urlPattern string, sampleId string, deprecated boolean, providerCode string, mirId string, institution {INSTITUTION_STRUCT}>"
REGISTRY = f"namespaces array<struct<prefix string, pattern string, sampleId string, deprecated boolean, namespaceEmbeddedInLui boolean, resources array<{RESOURCE_STRUCT}>>>"
HOP = "struct<url string, ip_port string, response_time int, status int, dns_error boolean, ssl_error boolean, invalid_response boolean>"
PING = f"rid bigint, lui string, random boolean, date string, redirects array<{HOP}>, content string, content_type string"
JOB = "rid bigint, lui string, random boolean, url string"
KNOWN_IDS = "known map<string, array<string>>"
TAGS = "identity string, tags array<string>"
ANALYSIS = "struct<lui string, information_content double, length bigint, noise bigint>"
DATAMINE = f"id bigint, pings array<struct<lui string, random boolean, date string, redirects array<{HOP}>, empty_content boolean>>, analysis array<{ANALYSIS}>"
ENTITY = "struct<uuid string, matches array<string>, name string, homeUrl string, description string, rorId string, location struct<countryCode string, countryName string>>"
ACADEMINE = f"id bigint, string string, entities array<{ENTITY}>"
SESSION = "validators array<string>, valid_luis_threshold int, random_luis_threshold int, position int, visited array<int>"
