"""Fixed values of the alert and topology domain, in their natural order."""

#: Alert buckets by the substrings of an alert type; the first bucket with a hit counts.
ALERT_BUCKETS = {
    "cpu": ["cpu_spike", "cpu_high", "high_cpu"],
    "latency": ["latency", "api_latency", "high_latency", "slow_response", "response_time"],
    "packet_drop": ["packet_drop", "packet_loss"],
    "link_errors": ["link_errors", "link_down", "interface_errors", "port_down", "interface_flap", "port_flap"],
    "connection_timeout": ["connection_timeout", "connection_refused", "connection_drop", "connection_reset"],
    "auth_errors": ["auth_errors", "auth_failure", "authentication_failed", "auth_denied"],
    "backend_pool_unhealthy": ["backend_pool_unhealthy", "unhealthy_backend", "pool_error", "backend_failure"],
    "user_timeout": ["user_timeout", "session_timeout", "request_timeout"],
    "route_flap": ["route_flap", "bgp_flap", "ospf_flap"],
    "dependency_error": ["dependency_error", "service_unavailable", "upstream_failure"],
}

#: Bucket sequences along which faults spread, in order.
PROPAGATION = [
    ("link_errors", "packet_drop"),
    ("link_errors", "packet_drop", "connection_timeout"),
    ("link_errors", "packet_drop", "latency"),
    ("link_errors", "latency"),
    ("packet_drop", "connection_timeout"),
    ("packet_drop", "latency"),
    ("packet_drop", "connection_timeout", "user_timeout"),
    ("cpu", "latency"),
    ("cpu", "latency", "user_timeout"),
    ("cpu", "connection_timeout"),
    ("auth_errors", "connection_timeout"),
    ("auth_errors", "user_timeout"),
    ("backend_pool_unhealthy", "latency"),
    ("backend_pool_unhealthy", "connection_timeout"),
    ("backend_pool_unhealthy", "user_timeout"),
    ("latency", "user_timeout"),
    ("connection_timeout", "user_timeout"),
    ("route_flap", "packet_drop"),
    ("route_flap", "link_errors"),
    ("route_flap", "latency"),
    ("dependency_error", "latency"),
    ("dependency_error", "connection_timeout"),
]

#: Severity scores of root-cause features and of correlation, ranks, rule scores.
SEVERITY_SCORE = {"critical": 1.0, "high": 0.8, "warning": 0.6, "medium": 0.5, "low": 0.3, "info": 0.1}
SEVERITY_CORRELATION = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "info": 0.10}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

#: How likely a kind of node is a root, and the buckets that fit it.
NODE_PRIORITY = {"firewall": 0.95, "router": 0.90, "cloud": 0.85, "wan": 0.85, "load_balancer": 0.80, "switch": 0.70, "database": 0.65, "server": 0.55, "service": 0.50}
NODE_BUCKETS = {
    "firewall": ["packet_drop", "connection_timeout", "link_errors", "auth_errors"],
    "router": ["packet_drop", "link_errors", "latency"],
    "cloud": ["packet_drop", "link_errors", "latency"],
    "wan": ["packet_drop", "link_errors", "latency"],
    "load_balancer": ["backend_pool_unhealthy", "connection_timeout", "latency"],
    "server": ["cpu", "latency", "connection_timeout", "user_timeout"],
    "database": ["latency", "connection_timeout", "cpu"],
    "service": ["auth_errors", "latency", "connection_timeout"],
    "switch": ["link_errors", "packet_drop"],
}

#: Weights of a cluster's five dimensions within one diagram and across diagrams.
WEIGHTS_TOPOLOGY = {"temporal": 0.30, "topology": 0.35, "alert_type_seq": 0.20, "source_peer": 0.15, "cross_diagram": 0.0}
WEIGHTS_ENTERPRISE = {"temporal": 0.25, "topology": 0.30, "alert_type_seq": 0.20, "source_peer": 0.10, "cross_diagram": 0.15}
