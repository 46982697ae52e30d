"""Curated questions and the named queries that answer them."""

from __future__ import annotations

VERIFIED = {
    "top_consumers": "Who are the top 10 customers by energy consumption?",
    "high_risk_transformers": "Which transformers are at highest risk of failure?",
    "verified_monthly_usage_trend": "What is the monthly energy usage trend?",
    "verified_customer_segment_analysis": "How does consumption vary by customer segment?",
    "verified_stress_by_area": "Which areas have the most transformer stress?",
    "storm_outages_by_cause": "How many outages occurred during the storm by cause?",
    "verified_outages_total_summary": "What is the total outage count and customers affected by cause?",
    "verified_daily_consumption_by_meter": "What is the daily consumption of one meter?",
    "verified_peak_hour_demand": "What is the total consumption during peak hours?",
    "verified_yoy_comparison": "How does one month compare between years?",
    "verified_sag_analysis": "How many voltage sags occurred by type?",
    "verified_transformers_by_health": "What is the health distribution of the transformer fleet?",
    "verified_overloaded_transformers": "Which transformers were overloaded recently?",
    "substation_capacity": "What is the total capacity by group of substations?",
    "verified_aging_fleet": "How many transformers are older than 30 years by manufacturer?",
    "hex_density": "How many transformers are in each cell?",
}
