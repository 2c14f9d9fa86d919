"""Source schema (namespace) of each logical table, as published for replication."""

# Schema of each base table.
TABLE_SCHEMA = {
    "warehouses": "warehouse", "locations": "warehouse", "products": "products", "inventory": "inventory",
    "inventory_movements": "inventory", "orders": "orders", "order_items": "orders", "customers": "customers",
    "shipments": "shipping", "shipment_items": "shipping", "receipts": "receiving", "receipt_items": "receiving",
}
