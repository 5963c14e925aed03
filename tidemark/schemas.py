"""Declared schemas of the raw captures and the main tables."""

CANDLE_FILE = """
schema_version int, source string, period_interval_minutes int, series_ticker string, city string, event_ticker string,
start_ts long, end_ts long,
market_metadata array<struct<ticker:string, yes_sub_title:string, strike_type:string, floor_strike:double, close_time:string, expiration_time:string, result:string>>,
candlestick_response struct<markets:array<struct<market_ticker:string, candlesticks:array<struct<
  end_period_ts:long,
  yes_bid:struct<open_dollars:string,high_dollars:string,low_dollars:string,close_dollars:string>,
  yes_ask:struct<open_dollars:string,high_dollars:string,low_dollars:string,close_dollars:string>,
  price:struct<open_dollars:string,high_dollars:string,low_dollars:string,mean_dollars:string,close_dollars:string,previous_dollars:string>,
  volume_fp:string, open_interest_fp:string>>>>>
"""

FORECAST_FILE = "retrieved_at string, station string, cycle string, data array<struct<runtime:string, ftime_utc:string, txn:double, xnd:double, tmp:double, tsd:double>>"

QUOTE = """
session_id string, cycle long, batch int, conid long, received_at timestamp, last string, bid string, ask string, bid_size string, ask_size string,
availability string, field_presence map<string,boolean>
"""

OBSERVATION = "observation_key string, station string, local_time timestamp, temperature_f double, metar string, received_at timestamp"
