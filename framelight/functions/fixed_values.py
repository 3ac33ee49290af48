"""Tables of the audit's domain: framing profiles, category standards, category phrases, word lists."""

# They must equal the audited application's for equal results.
PROFILES = {
    "tall": {"target_height": 0.80, "max_width": 0.66, "alignment": "bottom_center", "baseline": 0.91},
    "boxy": {"target_height": 0.72, "max_width": 0.74, "alignment": "bottom_center", "baseline": 0.89},
    "wide": {"target_width": 0.82, "max_height": 0.62, "alignment": "center"},
    "flat": {"target_width": 0.84, "max_height": 0.44, "alignment": "center"},
    "compact": {"target_height": 0.70, "max_width": 0.68, "alignment": "bottom_center", "baseline": 0.89},
}

# Fixed values.
AMAZON_A_PROFILES = {
    "tall": {"target_height": 0.88, "max_width": 0.82, "alignment": "bottom_center", "baseline": 0.94},
    "boxy": {"target_height": 0.84, "max_width": 0.84, "alignment": "center"},
    "wide": {"target_width": 0.90, "max_height": 0.68, "alignment": "center"},
    "flat": {"target_width": 0.90, "max_height": 0.50, "alignment": "center"},
    "compact": {"target_height": 0.80, "max_width": 0.80, "alignment": "center"},
}

# Fixed values.
CATEGORY_PROFILE = {
    "Air conditioner": "wide", "Blender": "compact", "Cart / trolley": "wide", "Coffee machine": "boxy", "Citrus press": "boxy", "Cooktop": "flat",
    "Dishwasher": "tall", "Freezer": "tall", "Hob": "flat", "Hood": "wide", "Ice cream maker": "wide", "Ice machine": "boxy", "Juicer": "boxy",
    "Kettle": "compact", "Laundry equipment": "boxy", "Microwave": "boxy", "Oven": "boxy", "Refrigerator": "tall", "Vacuum cleaner": "boxy",
    "Waffle maker": "wide", "Water dispenser": "tall", "Water heater": "tall",
}

# Fixed values.
CATEGORY_STANDARDS = {
    "Air conditioner": {"target_width": 0.82, "max_height": 0.58, "alignment": "center"},
    "Coffee machine": {"target_height": 0.72, "max_width": 0.74, "alignment": "bottom_center", "baseline": 0.89},
    "Citrus press": {"target_height": 0.78, "max_width": 0.76, "alignment": "center"},
    "Cooktop": {"target_width": 0.84, "max_height": 0.46, "alignment": "center"},
    "Dishwasher": {"target_height": 0.79, "max_width": 0.70, "alignment": "bottom_center", "baseline": 0.91},
    "Freezer": {"target_height": 0.81, "max_width": 0.68, "alignment": "bottom_center", "baseline": 0.92},
    "Hob": {"target_width": 0.84, "max_height": 0.46, "alignment": "center"},
    "Hood": {"target_width": 0.82, "max_height": 0.68, "alignment": "center"},
    "Ice cream maker": {"target_width": 0.82, "max_height": 0.72, "alignment": "center"},
    "Juicer": {"target_height": 0.80, "max_width": 0.80, "alignment": "center"},
    "Microwave": {"target_height": 0.67, "max_width": 0.78, "alignment": "center"},
    "Oven": {"target_height": 0.72, "max_width": 0.76, "alignment": "center"},
    "Refrigerator": {"target_height": 0.82, "max_width": 0.66, "alignment": "bottom_center", "baseline": 0.92},
    "Water heater": {"target_height": 0.78, "max_width": 0.68, "alignment": "center"},
    "Cart / trolley": {"target_width": 0.78, "max_height": 0.70, "alignment": "center"},
    "Ice machine": {"target_height": 0.72, "max_width": 0.76, "alignment": "bottom_center", "baseline": 0.90},
    "Laundry equipment": {"target_height": 0.78, "max_width": 0.74, "alignment": "bottom_center", "baseline": 0.91},
    "Vacuum cleaner": {"target_height": 0.78, "max_width": 0.80, "alignment": "center"},
    "Waffle maker": {"target_width": 0.82, "max_height": 0.72, "alignment": "center"},
    "Water dispenser": {"target_height": 0.80, "max_width": 0.66, "alignment": "bottom_center", "baseline": 0.91},
}

# The anchor that a category's products are placed by.
CATEGORY_ANCHOR = {
    "Air conditioner": "full_center", "Cart / trolley": "full_center", "Coffee machine": "primary", "Citrus press": "full_center", "Cooktop": "full_center", "Dishwasher": "primary",
    "Freezer": "primary", "Hob": "full_center", "Hood": "visual_center", "Ice cream maker": "full_center", "Ice machine": "primary", "Juicer": "full_center",
    "Laundry equipment": "primary", "Microwave": "full_center", "Oven": "full_center", "Refrigerator": "primary", "Vacuum cleaner": "full_center", "Waffle maker": "full_center",
    "Water dispenser": "primary", "Water heater": "full_center",
}
ANCHORS = ["primary", "full_center", "visual_center"]  # fixed values

# Phrases of each category, in the order in which ties are broken.
CATEGORY_TERMS = {
    "Coffee machine": ["coffee machine", "coffee maker", "coffee brewer", "espresso", "bean to cup", "bean-to-cup", "cappuccino", "coffee vending"],
    "Microwave": ["microwave", "micro wave"],
    "Oven": ["built in oven", "built-in oven", "electric oven", "convection oven", "combi oven", "commercial oven"],
    "Refrigerator": ["refrigerator", "refrigeration cabinet", "fridge"],
    "Freezer": ["freezer", "freezing cabinet"],
    "Air conditioner": ["air conditioner", "air conditioning", "split ac", "split a/c", "cassette ac", "portable ac", "ducted ac"],
    "Water heater": ["water heater", "geyser", "calorifier", "hot water boiler"],
    "Hob": ["hob", "induction hob", "gas hob"],
    "Citrus press": ["citrus press", "citrus juicer", "orange press"],
    "Cooktop": ["cooktop", "cook top"],
    "Hood": ["extractor hood", "range hood", "cooker hood", "chimney hood", "kitchen hood"],
    "Dishwasher": ["dishwasher", "dish washer"],
    "Laundry equipment": ["washer extractor", "washer-extractor", "washing machine", "tumble dryer", "tumble drier", "spin washer", "laundry machine", "industrial dryer", "commercial dryer"],
    "Cart / trolley": ["cart", "trolley", "utility cart", "laundry cart", "linen cart"],
    "Ice cream maker": ["ice cream maker", "ice-cream maker", "smart scoop"],
    "Ice machine": ["ice machine", "ice maker", "ice-maker"],
    "Juicer": ["juicer", "nutri juicer", "juice extractor"],
    "Water dispenser": ["water dispenser", "water cooler"],
    "Blender": ["blender"],
    "Kettle": ["kettle"],
    "Vacuum cleaner": ["vacuum cleaner", "robot vacuum", "robotic vacuum", "cordless vacuum", "wet and dry vacuum", "floor cleaner", "deebot", "roborock", "dyad"],
    "Waffle maker": ["waffle maker", "waffle machine"],
}

# Words of product names and addresses that tell archetypes.
ROBOT_WORDS = ["deebot", "robot vacuum", "robotic vacuum", "robot cleaner"]
STATION_WORDS = ["omni", "station", "self-empty", "self empty", "wash/dry", "washing", "hot air drying", "mop"]
CORDLESS_WORDS = ["cordless", "wet and dry", "dyad", "stick vacuum"]
CHIMNEY_WORDS = ["chimney", "wall mounted"]

# Texts that mark page furniture, not products.
NOISE_WORDS = [
    "logo", "icon", "arrow", "chevron", "facebook", "instagram", "linkedin", "youtube", "twitter", "x.com", "placeholder", "spinner",
    "payment", "visa", "mastercard", "whatsapp", "search", "menu", "account", "cart", "follow us", "follow-us", "follow_us", "google play",
    "get it on google play", "play store", "app store", "download on the app store", "download app", "download our app", "mobile app",
    "app badge", "store badge", "newsletter", "subscribe", "copyright", "social media", "qr code", "scan qr", "contact us",
]

# Query keys of page numbers.
PAGE_KEYS = ["page", "paged", "pageno", "page_no", "page-number", "page_number", "pg", "product-page", "product_page"]

# The audit table's columns.
AUDIT_COLUMNS = [
    "main_category", "subcategory", "page_label", "page_url", "product_name", "product_url", "status", "operator_decision",
    "manual_edit_applied", "manual_zoom", "manual_move_left_right", "manual_move_up_down", "manual_floor_line", "manual_crop_left",
    "manual_crop_right", "manual_crop_top", "manual_crop_bottom", "manual_body_mode", "manual_center_mode", "consistency_score",
    "problem_summary", "suggested_fix", "profile", "subtype", "comparison_group", "body_height_occupancy", "body_width_occupancy",
    "horizontal_center_offset", "body_baseline_y", "full_edge_padding", "accessory_area_ratio", "component_count", "current_image_file",
    "normalized_image_file", "comparison_image_file", "visual_report_section",
]

# Headings of the exports; the simple one has those up to "Subtype".
EXPORT_HEADINGS = {
    "Main Category": "main_category", "Subcategory": "subcategory", "Page Label": "page_label", "Product Name": "product_name",
    "Product URL": "product_url", "Product Status": "status", "Operator Decision": "operator_decision", "Manual Edit": "manual_edit_applied",
    "Manual Zoom": "manual_zoom", "Manual Left / Right": "manual_move_left_right", "Manual Up / Down": "manual_move_up_down",
    "Manual Floor Line": "manual_floor_line", "Crop Left": "manual_crop_left", "Crop Right": "manual_crop_right", "Crop Top": "manual_crop_top",
    "Crop Bottom": "manual_crop_bottom", "Manual Body Mode": "manual_body_mode", "Manual Center Mode": "manual_center_mode",
    "Problem Summary": "problem_summary", "Consistency Score": "consistency_score", "Suggested Fix": "suggested_fix", "Profile": "profile",
    "Subtype": "subtype", "Comparison Group": "comparison_group", "Body Height Occupancy": "body_height_occupancy",
    "Body Width Occupancy": "body_width_occupancy", "Horizontal Center Offset": "horizontal_center_offset", "Body Baseline": "body_baseline_y",
    "Full Edge Padding": "full_edge_padding", "Accessory Area Ratio": "accessory_area_ratio", "Component Count": "component_count",
    "Current Image File": "current_image_file", "Normalized Image File": "normalized_image_file", "Before / After Image File": "comparison_image_file",
}
